"""Reading and writing records, models and reports."""

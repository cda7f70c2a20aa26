"""Training and scoring plans made of operators, and the registered queries."""

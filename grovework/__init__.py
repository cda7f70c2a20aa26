"""Decision forests, raster tables and corpus preparation as Spark jobs."""

"""Near-parallel row search and sparse-matrix work as Spark jobs."""

"""gridscale: Spark-first refinement of gridded monthly time series."""

"""Market time-series analytics and trade accounting as Spark jobs."""

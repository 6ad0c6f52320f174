"""Point-in-time time-series analytics as Spark plans."""

"""Customer-grain risk analytics as Spark DataFrame jobs."""

"""SQL traffic threat analytics as Spark DataFrame jobs."""

"""Purchase-sequence analytics as Spark DataFrame jobs."""

"""Type-annotation corpus analytics as Spark DataFrame jobs."""

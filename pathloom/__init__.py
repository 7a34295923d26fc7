"""Knowledge-graph preparation, auditing and evaluation as Spark DataFrame jobs."""

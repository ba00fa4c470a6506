"""Document retrieval, verification and evaluation as Spark DataFrame jobs."""

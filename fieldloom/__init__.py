"""Document-field extraction and quality evaluation as Spark DataFrame jobs."""

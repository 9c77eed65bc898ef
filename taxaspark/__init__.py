"""Incremental category learning and corpus preparation, expressed as Spark DataFrame plans."""

"""Document text and retrieval analytics on PySpark."""

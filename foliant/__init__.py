"""Document and usage analytics on PySpark."""

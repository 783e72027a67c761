"""Document-evaluation analytics on Spark."""

"""Document-structure and annotation analytics on Spark."""

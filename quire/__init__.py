"""Document-translation analytics on Spark."""

"""Climate index analytics on Spark."""

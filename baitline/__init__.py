"""Message risk analytics on Spark."""

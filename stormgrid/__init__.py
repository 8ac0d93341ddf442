"""Event and grid analytics on Spark."""

"""Change histories as tables and streams, on Spark."""

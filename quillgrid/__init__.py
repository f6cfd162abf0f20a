"""Document-table analytics on Spark."""

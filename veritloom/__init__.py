"""Knowledge-graph compilation and querying on Spark."""

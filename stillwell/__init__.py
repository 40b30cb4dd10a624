"""Driver-response analytics on Spark: irregular readings explained by a dense daily driver."""

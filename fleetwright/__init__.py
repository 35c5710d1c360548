"""Fleet analytics and data jobs for keyed data streams, on Spark."""

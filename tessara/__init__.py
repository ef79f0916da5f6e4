"""A Spark-first analytics engine: strict SQL, retrieval and ordered-log processing."""

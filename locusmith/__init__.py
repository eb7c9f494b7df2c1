"""locusmith: Spark-first analytics over addressable text."""

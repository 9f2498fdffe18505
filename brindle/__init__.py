"""A Spark-native engine for a small, strict SQL dialect."""

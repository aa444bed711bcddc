"""tarnwick: a PySpark-native analytics engine (DataFrame, SQL, Structured Streaming)."""

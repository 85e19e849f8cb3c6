"""Log analytics on Spark: format detection, severity, filtering, indexing and tailing of ordered text lines."""

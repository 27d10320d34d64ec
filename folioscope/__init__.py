"""Document analytics on Spark: text keys, span matching, retrieval, gates, metrics."""

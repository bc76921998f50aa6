"""Document-audit analytics on Spark: ingestion, chunking, retrieval, graph analytics, scoring and run history."""

"""Tallyport: Spark-native auditing of large-file ingestion, at fleet scale."""

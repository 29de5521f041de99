"""Spark-native engine for multimodal corpus classification and deduplication."""

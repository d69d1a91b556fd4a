"""Spark-native engine for marker-based scripture markup and text corpora."""

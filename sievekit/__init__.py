"""Spark-native curation and evaluation analytics for text and code benchmarks."""

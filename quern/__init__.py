"""Spark-native curation of large text corpora."""

"""Spark-native analytics over text corpora and retrieval rankings."""

__version__ = "0.1.0"

"""Spark-native analytics over typed, multi-taxonomy knowledge graphs."""

__version__ = "0.1.0"

"""Spark-native analytics for sports-market tables."""

__version__ = "0.1.0"

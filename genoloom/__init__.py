"""Spark-native analytics for statistical genetics and the tables around it."""

__version__ = "0.1.0"

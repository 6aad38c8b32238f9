"""Spark-native sequence-feature analytics."""

__version__ = "0.1.0"

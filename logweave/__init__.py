"""Spark-native log structuring engine."""

__version__ = "0.1.0"

"""Spark-native change analytics over per-pixel observation series."""

__version__ = "0.1.0"

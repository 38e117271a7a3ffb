"""Spark-native measurement of machine-learning datasets."""

__version__ = "0.1.0"

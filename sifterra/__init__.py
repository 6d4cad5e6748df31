"""Spark-native text retrieval, evaluation and corpus processing."""

__version__ = "0.1.0"

"""Spark-native document-DLP analytics engine."""

__version__ = "0.1.0"

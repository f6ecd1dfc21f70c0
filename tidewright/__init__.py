"""Spark-native declarative pipelines and analytics."""

__version__ = "0.1.0"

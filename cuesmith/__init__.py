"""Spark-native transcript retrieval and analytics."""

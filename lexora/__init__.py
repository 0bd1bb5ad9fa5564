"""Spark-native analytics and entity-resolution operators."""

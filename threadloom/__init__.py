"""Spark-native threaded-text search and analytics."""

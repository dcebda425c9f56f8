"""Spark-native analytics for large translation corpora."""

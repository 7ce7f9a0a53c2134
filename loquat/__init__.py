"""Spark-native analytics over text memory."""

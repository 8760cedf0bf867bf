"""Spark-native analytics over chunked n-dimensional arrays."""

"""Spark-native analytics over software test results."""

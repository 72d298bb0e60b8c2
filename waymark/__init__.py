"""Spark-native operators for trips, intervals and timed state."""

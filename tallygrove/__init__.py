"""Spark-native analytics for issue-tracker data."""

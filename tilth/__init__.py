"""Spark-native analytics for on-farm strip trials."""

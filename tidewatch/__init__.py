"""Spark-native news and market intelligence engine."""

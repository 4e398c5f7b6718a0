"""Spark-native pulse-signal reliability analytics."""

"""Spark-native line-of-sight and obstruction analytics."""

"""Spark-native cross-sectional factor research."""

"""Spark-native analysis of long-format monitoring observations."""

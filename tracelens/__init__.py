"""Spark-native conversation analytics."""

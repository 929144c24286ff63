"""Spark-native accounting and treasury analytics."""

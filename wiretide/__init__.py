"""Spark-native flow analytics."""

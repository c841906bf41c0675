"""Spark-native engine for feed and signal analytics."""

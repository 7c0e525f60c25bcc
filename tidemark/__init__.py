"""Spark-native transport-security analytics."""

"""Spark-native column functions, queries and corpus operators."""

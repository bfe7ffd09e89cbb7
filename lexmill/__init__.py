"""Spark-native corpus building, retrieval and evaluation."""

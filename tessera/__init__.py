"""Spark-native engine for interpretable image classification."""

"""Spark-native engine for preparing, scoring and refining visual text-grounding data."""

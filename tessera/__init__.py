"""Spark-native exploratory analytics for text and categorical data."""

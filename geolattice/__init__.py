"""Spark-native engine for visual-geolocation data: retrieval, re-ranking,
spatial validation, camera geometry, evaluation and dataset building."""

__version__ = "0.1.0"

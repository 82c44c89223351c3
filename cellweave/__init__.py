"""Spark-native analytics for spatial, multi-layer single-cell data."""

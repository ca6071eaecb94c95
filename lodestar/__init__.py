"""Spark-native analytics for gridded geoscience and sequential decision data."""

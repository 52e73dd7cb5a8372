"""Spark-native analytics for multispectral field surveys and training-text corpora."""

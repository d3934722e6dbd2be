"""Spark-native span analytics for long documents: segmentation, retrieval, classification, judging and their metrics."""

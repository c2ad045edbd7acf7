"""Spark-native hybrid retrieval and analysis engine over time-segmented data."""

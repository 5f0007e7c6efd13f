"""Spark-native analytics over facts about data and software systems."""

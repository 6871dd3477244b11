"""Spark-native hybrid retrieval and knowledge-graph analytics."""

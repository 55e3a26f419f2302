"""Fathomline: a Spark-native engine for graph-augmented retrieval, ranking and corpus preparation."""

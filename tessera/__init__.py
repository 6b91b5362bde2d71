"""Tessera: a Spark-native engine for record retrieval, usage mining and maintenance analytics."""

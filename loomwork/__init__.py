"""Loomwork: a Spark-native engine for web content, documents and retrieval."""

"""Spark-native entity extraction and analytics over large document collections."""

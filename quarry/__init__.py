"""Quarry: Spark-native analytics over corpora of source code and text."""

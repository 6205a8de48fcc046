"""Spark-native analytics over graphs, ontologies and text."""

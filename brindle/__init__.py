"""Spark-native content enrichment and analytics engine."""

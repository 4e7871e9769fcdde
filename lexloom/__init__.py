"""Spark-native listing, matching and text-analytics engine."""

"""Spark-native approximate record matching and de-duplication."""

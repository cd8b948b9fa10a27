"""Spark-native analytics over imaging frames, star tables, run ledgers and a document corpus."""

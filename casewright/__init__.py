"""Spark-native curation engine for case and image catalogs."""

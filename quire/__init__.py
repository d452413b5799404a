"""Quire: a PySpark-native analytics engine for long-form text corpora."""

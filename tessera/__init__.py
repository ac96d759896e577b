"""Spark-native reconciliation and quality analytics for versioned text corpora."""

"""Spark-native evidence analytics: relational read models, text extraction, evidence graph."""

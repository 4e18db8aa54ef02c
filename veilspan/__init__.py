"""Spark jobs that find, validate, score, count and redact sensitive identifiers in large text tables."""

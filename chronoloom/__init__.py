"""Spark-first analytics over temporal knowledge graphs built from text."""

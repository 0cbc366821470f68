"""Semantic-relation analytics as PySpark DataFrame operators."""

"""Manuscript analytics as PySpark DataFrame operators."""

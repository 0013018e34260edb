"""Narrative text analytics as PySpark DataFrame operators."""

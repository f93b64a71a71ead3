"""Sequence, survey and text analytics as PySpark DataFrame operators."""

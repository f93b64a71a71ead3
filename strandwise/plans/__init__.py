"""Composed analyses built from the operators."""

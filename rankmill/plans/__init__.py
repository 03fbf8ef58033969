"""Whole pipelines of operators."""

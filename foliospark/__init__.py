"""Retrieval analytics on Spark: scoring, ranking, metrics and corpus checks as DataFrame plans."""

__version__ = "0.1.0"

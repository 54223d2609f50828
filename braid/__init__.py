"""Hybrid search on Spark: vector distance and full text, fused by rank."""

__version__ = "0.1.0"

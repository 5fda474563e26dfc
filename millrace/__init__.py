"""Spark-first retrieval, evidence and text-preparation analytics."""

__version__ = "0.1.0"

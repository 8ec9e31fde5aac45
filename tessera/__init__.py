"""Tessera: a Spark-first engine for retrieval analytics over text and vectors."""

__version__ = "0.1.0"

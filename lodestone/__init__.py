"""Lodestone: Spark-first analytics over code-symbol graphs."""

__version__ = "0.1.0"

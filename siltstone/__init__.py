"""Siltstone: overlap analytics between text corpora and evaluation sets, on PySpark."""

__version__ = "0.1.0"

"""Corpusmill: crawled pages to searchable, verifiable passages, as PySpark DataFrame transformations."""

__version__ = "0.1.0"

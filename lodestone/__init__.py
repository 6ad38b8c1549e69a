"""Lodestone: governed, reproducible snapshots of large tables, as Spark jobs."""

__version__ = "0.1.0"

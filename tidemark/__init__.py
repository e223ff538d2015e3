"""Tidemark: a PySpark-native engine for keyed tables, SQL, search, ingest and incremental views."""

__version__ = "0.1.0"

"""Curation of delimited text records and exact-match lookup over them, on Spark."""

__version__ = "0.1.0"

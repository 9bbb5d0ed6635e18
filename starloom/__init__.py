"""Declarative feature analytics over star-schema data, planned as plain Spark DataFrames."""

__version__ = "0.1.0"

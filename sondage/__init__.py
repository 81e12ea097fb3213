"""Code and text search over Spark DataFrames."""

__version__ = "0.1.0"

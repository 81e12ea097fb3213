"""The query language: parsing, compilation to columns, and narrowing by the index."""

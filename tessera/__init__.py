"""Queries over collections of JSON-like documents, planned as Spark DataFrames."""

"""Queries over the given tables, each with the same query in DuckDB's SQL."""

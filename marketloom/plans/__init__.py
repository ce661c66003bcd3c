"""Pipelines of operators, and the queries over the given tables with their SQL."""

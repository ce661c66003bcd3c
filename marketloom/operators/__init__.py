"""Operators: DataFrames in, DataFrames out; none runs an action."""

"""Operators: DataFrames in, DataFrames out, nothing run until an action is."""

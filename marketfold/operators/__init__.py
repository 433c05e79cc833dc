"""Reusable DataFrame operators: each takes DataFrames and column names."""

"""Operators: each takes and returns DataFrames, with no action on fact-sized data."""

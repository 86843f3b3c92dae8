"""Operators on DataFrames keyed by date and id."""

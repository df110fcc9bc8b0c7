"""Operators over DataFrames: search, change logs, id sets, top-k."""

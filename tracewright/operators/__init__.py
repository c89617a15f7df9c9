"""Operators: each takes and returns DataFrames and declares a plan; none of them collects data rows."""

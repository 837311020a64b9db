"""Set-oriented operators: each takes DataFrames and returns a DataFrame."""

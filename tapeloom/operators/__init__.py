"""Relational and time-series operators: every function takes and returns lazy DataFrames."""

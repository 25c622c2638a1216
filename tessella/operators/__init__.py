"""Operators: functions from DataFrames to a DataFrame. Order is always data (pos, seq or key columns)."""

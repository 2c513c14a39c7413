"""Operators: functions from DataFrames to DataFrames, with column names and thresholds as parameters."""

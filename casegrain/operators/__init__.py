"""Operators: functions from DataFrames and columns to DataFrames and columns."""

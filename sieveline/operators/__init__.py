"""Relational and text operators: functions from DataFrames to DataFrames."""

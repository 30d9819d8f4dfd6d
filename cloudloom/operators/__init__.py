"""Operators on labelled point clouds: functions from DataFrames to a DataFrame."""

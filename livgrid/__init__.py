"""Livability analytics on Spark DataFrames: zones, prices, timetables, rasters, graphs."""

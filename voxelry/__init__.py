"""Spatial and field analytics on Spark DataFrames."""

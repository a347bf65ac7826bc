"""Spatial tables, grids and feature overlays on Spark DataFrames."""

"""Melt-pool sensor analytics on Spark DataFrames."""

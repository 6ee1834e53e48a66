"""Keyed, path and unit operators over DataFrames."""

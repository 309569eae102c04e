"""Recursive rules over DataFrames."""

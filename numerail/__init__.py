"""Exact-number and ordered-sequence analytics on Spark DataFrames."""

"""Temporal attributed-graph analytics on Spark DataFrames."""

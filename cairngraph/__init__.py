"""Dependency-graph analytics on Spark DataFrames."""

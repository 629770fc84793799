"""Incremental relational analytics on Spark DataFrames."""

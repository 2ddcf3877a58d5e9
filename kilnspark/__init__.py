"""Hybrid retrieval and document analytics on Spark DataFrames."""

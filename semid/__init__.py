"""Semantic-ID analytics on Spark DataFrames."""

"""Ranked full-text retrieval and data processing over Spark DataFrames."""

"""Bitemporal, as-of-a-bookmark analytics on Spark DataFrames."""

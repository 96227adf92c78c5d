"""Keyed-timeline analytics on Spark DataFrames."""

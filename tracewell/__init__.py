"""Gather analytics on Spark: trace tables, windows, picks, trends, tiles."""

"""Tessella: a relational query engine that lowers to Spark DataFrames."""

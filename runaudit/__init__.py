"""Audit evidence over recorded machine runs, as Spark DataFrames."""

"""Audit whole corpora of source repositories as Spark DataFrames."""

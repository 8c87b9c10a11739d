"""Moraine: search, log, change-feed and corpus processing on PySpark DataFrames."""

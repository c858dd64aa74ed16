"""Interval, span and timeline analytics on Spark DataFrames."""

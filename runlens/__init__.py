"""Repeated A/B measurement analytics on Spark DataFrames."""

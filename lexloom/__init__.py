"""Corpus quality, sampling and evaluation analytics on Spark DataFrames."""

"""Corpus operators: each takes and returns DataFrames."""

"""Readers: raw files -> typed DataFrames."""

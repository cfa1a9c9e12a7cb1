"""Readers to typed DataFrames."""

"""Operators on DataFrames of sources and findings."""

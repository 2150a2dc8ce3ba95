"""Relational and array operators on DataFrames."""

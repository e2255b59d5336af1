"""Operators on DataFrames: each module one family of the catalogue's steps."""

"""Operators on matrices held as DataFrames of cells (r, c, v)."""

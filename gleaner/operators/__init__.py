"""Relational, vector and model operators: lazy DataFrames in, lazy DataFrames out."""

"""Equi-joins of two large relations, and what belongs to them, on Spark's DataFrames."""

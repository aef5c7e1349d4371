"""Relational operators of record linkage over DataFrames."""

"""Scalar functions: column expressions, and Arrow functions where Spark has none."""

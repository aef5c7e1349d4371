"""Whole plans: queries over the test tables, with their SQL, and the linkage pipeline."""

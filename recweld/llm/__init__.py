"""Operators for preparing text corpora for training language models.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""

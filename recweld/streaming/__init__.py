"""Structured Streaming: matching of records as they arrive."""

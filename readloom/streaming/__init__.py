"""Structured Streaming forms of the loading operators."""

"""Readers and writers for text and block-compressed alignment formats."""

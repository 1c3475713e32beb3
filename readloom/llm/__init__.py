"""Operators on document corpora: packing, mixing, subject areas. Nothing outside this package imports it."""

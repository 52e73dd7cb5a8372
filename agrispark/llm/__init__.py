"""Operators for large text corpora: de-duplication, filtering, extraction, packing and formatting."""

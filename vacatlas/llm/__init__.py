"""Operators for preparing training text: archives, scoring, packing, near-duplicates, output files."""

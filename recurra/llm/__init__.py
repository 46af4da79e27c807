"""Operators for large text corpora: dedup, decontamination, scoring, packing."""

"""Operators for building training corpora: deduplication, filtering, decontamination, formatting and packing."""

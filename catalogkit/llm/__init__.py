"""Operators for training-data pipelines: language ID, deduplication,
decontamination, secret scans, mixing, scoring, archives and formatting.

Nothing outside this subpackage imports it.
"""

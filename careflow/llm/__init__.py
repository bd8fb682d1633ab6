"""Operators for preparing training text: quality, duplicates, contamination, personal data, packing.

Nothing outside this subpackage imports it.
"""

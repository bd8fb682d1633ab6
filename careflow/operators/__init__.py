"""Reusable table operators: ordered computations, paging, validation, changes."""

"""Column expressions and row filters."""

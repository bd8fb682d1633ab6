"""Table readers, sheet imports, report and snapshot writers."""

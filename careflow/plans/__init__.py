"""Domain reports, lists and ledgers."""

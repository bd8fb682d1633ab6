"""Structured Streaming forms of the daily counts, alerts, session rule and ledger."""

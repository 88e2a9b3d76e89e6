"""Structured Streaming forms of the event, diff and ledger jobs."""

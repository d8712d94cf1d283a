"""Structured Streaming versions of the transaction and fraud jobs."""

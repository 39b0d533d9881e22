"""Structured Streaming: running window queries to their end and reading results."""

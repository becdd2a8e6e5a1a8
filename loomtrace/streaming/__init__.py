"""Structured Streaming forms of the audit aggregates."""

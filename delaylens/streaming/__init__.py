"""Structured Streaming forms of the incremental load and hourly summary."""

"""Structured Streaming forms of the packet source and the running aggregates."""

"""Incremental forms of the scan on Structured Streaming."""

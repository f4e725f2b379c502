"""Structured Streaming twins of jobs over live outputs."""

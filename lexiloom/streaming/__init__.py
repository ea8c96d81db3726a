"""Structured Streaming forms of ingest and of the trace log."""

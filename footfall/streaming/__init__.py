"""Ingest as Structured Streaming."""

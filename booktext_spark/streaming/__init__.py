"""Structured Streaming forms of the change-feed and ingest operators."""

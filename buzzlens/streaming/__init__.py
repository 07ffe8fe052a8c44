"""Structured Streaming forms of the ingest, mention and signal jobs."""

"""Structured Streaming forms of ingestion and status."""

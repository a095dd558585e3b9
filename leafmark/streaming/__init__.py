"""Structured Streaming ingestion of word dumps."""

"""Buffered and Structured Streaming ingestion."""

"""Arriving files and running summaries on Structured Streaming."""

"""Incremental pulls on Structured Streaming."""

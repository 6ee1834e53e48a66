"""Incremental loading and saving with Structured Streaming."""

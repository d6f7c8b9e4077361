"""Structured Streaming over event tables (an extension)."""

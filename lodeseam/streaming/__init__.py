"""Structured Streaming jobs that keep an index and sessions current."""

"""Readers, parsers and the persisted index."""

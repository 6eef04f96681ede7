"""Structured Streaming forms of the parsers and the confusion counts."""

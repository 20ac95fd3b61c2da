"""Structured Streaming forms of the grouped aggregates: an extension, sheets themselves have no streams."""

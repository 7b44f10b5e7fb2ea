"""Structured Streaming forms of what needs no whole method."""

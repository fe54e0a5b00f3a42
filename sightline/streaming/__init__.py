"""Structured Streaming entry points (rows 103, 104)."""

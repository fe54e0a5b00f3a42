"""Readers, fixture views over the test tables, and sinks."""

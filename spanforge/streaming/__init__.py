"""Operators on unbounded tables, by Structured Streaming."""

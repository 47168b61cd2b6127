"""Structured Streaming versions of the live jobs."""

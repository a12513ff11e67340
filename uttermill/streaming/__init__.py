"""Structured Streaming versions of the scoring operators."""

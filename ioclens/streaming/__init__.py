"""Structured Streaming versions of the continuous operators."""

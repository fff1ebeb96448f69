"""Structured Streaming versions of the stages."""

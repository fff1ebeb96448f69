"""Whole stages put together from operators."""

"""Structured Streaming jobs over live readings."""

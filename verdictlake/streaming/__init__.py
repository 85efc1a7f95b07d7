"""Structured Streaming jobs over arriving results and run events."""

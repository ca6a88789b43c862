"""Structured Streaming over the same windows."""

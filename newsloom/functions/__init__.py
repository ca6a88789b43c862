"""Scalar columns over articles, windows and text."""

"""Relational operators: metrics, windows, vectors, labels, splits, evaluation, drift."""

"""Operators for text training data. Nothing outside this package imports it."""

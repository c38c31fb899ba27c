"""Operators for large-scale preparation of training text."""

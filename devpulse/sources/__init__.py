"""Payload parsing, repository discovery and stored tables."""

"""Structured Streaming jobs: file ingest and live daily counts."""

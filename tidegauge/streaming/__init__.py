"""Structured Streaming forms of the sample summaries."""

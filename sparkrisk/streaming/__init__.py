"""Keyed state, deduplication, routing and monitoring on Structured Streaming."""

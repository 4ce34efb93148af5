"""Incremental rebuilds with Structured Streaming (beyond what the batch engine needs)."""

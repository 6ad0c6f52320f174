"""Incremental accumulation with Structured Streaming."""

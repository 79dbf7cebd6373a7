"""Structured Streaming forms of the session, event and latency metrics."""

"""Composite pipelines (P1-P7) and the registry of named queries."""

"""Relational operators (filters, joins, aggregates, windows, maintenance)."""

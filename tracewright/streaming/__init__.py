"""Incremental forms of the aggregates."""

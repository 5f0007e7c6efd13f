"""Lineage facts from parsed SQL plans."""

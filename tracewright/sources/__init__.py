"""Readers of files and facts, and writers of products."""

"""Readers of raw position text, and the source catalog."""

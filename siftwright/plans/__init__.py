"""Operators put together: the end-to-end enrichment, and queries over the standard tables."""

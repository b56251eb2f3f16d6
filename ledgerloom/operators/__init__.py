"""Relational operators over document-graph tables."""

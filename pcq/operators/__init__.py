"""Relational operators over point tables."""

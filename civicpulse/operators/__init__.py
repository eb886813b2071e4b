"""Relational operators over canonical requests."""

"""Relational operators over ticks."""

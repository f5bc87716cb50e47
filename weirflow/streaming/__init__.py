"""Handlers as streaming queries."""

"""Connectors that write."""

"""Connectors that read. register(spark) makes the streaming formats known to a session."""

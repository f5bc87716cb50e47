"""Services to try connectors against, on one machine."""

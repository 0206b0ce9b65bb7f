"""Event-time extensions."""

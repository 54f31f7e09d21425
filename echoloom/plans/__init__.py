"""Registered queries and planning of feature requests."""

"""Registered queries and the domain views that they read."""

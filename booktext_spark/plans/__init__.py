"""Registered queries over the driver tables, with their oracle SQL."""

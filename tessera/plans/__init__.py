"""Queries over the driver tables and whole site runs."""

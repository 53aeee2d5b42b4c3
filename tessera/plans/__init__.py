"""Registered queries over the star-schema tables, with their SQL."""

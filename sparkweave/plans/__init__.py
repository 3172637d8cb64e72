"""Queries over the input tables."""

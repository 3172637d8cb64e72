"""Operators on ordered tables."""

"""Lodestone sources."""

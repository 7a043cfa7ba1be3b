"""Lodestone plans."""

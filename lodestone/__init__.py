"""Lodestone."""

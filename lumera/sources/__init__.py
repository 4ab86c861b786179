"""Lumera sources."""

"""Lumera operators."""

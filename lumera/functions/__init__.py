"""Lumera functions."""

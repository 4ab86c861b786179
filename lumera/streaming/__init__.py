"""Lumera streaming."""

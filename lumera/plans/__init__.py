"""Lumera plans."""

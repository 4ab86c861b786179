"""Lumera: floating-point images as Spark relations, and the operators over them."""

__version__ = "0.1.0"

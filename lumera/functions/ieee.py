"""Floating-point arithmetic as IEEE 754 has it, where Spark raises or gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def fdiv(a: Column, b: Column) -> Column:
    """a / b with x/0 infinite and 0/0 not a number."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(F.isnan(a) | (a == 0), nan()).when(a > 0, inf()).otherwise(-inf())


def _log(f, x: Column) -> Column:  # noqa: ANN001
    return F.when(x > 0, f(F.when(x > 0, x))).when(x == 0, -inf()).otherwise(nan())


def ln(x: Column) -> Column:
    """Natural logarithm; 0 gives -infinity, less gives not a number."""
    return _log(F.ln, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def finite_or_zero(x: Column) -> Column:
    """Not a number and the infinities become 0."""
    return F.when(F.isnan(x) | (F.abs(x) == inf()), 0.0).otherwise(x)


def above(a: Column, b: Column | float) -> Column:
    """a > b, false for not a number."""
    return ~F.isnan(a) & (a > b)


def clamp(low: float, high: float, v: Column) -> Column:
    """v held between bounds; not a number passes."""
    return F.when(F.isnan(v), v).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), v)))


def product_of_nonzero(values: Column) -> Column:
    """Product of an array of integers, zeros left out; 1 for none."""
    return F.aggregate(F.filter(values, lambda v: v != 0), F.lit(1).cast("long"), lambda a, v: a * v)

"""From floating-point channels to 16-bit ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumera.functions.ieee import above, fdiv, ln

MAX = 65535


def inverse_pixel_mapping(v: Column) -> Column:
    """The largest index whose level ``(index - 1) / 65535`` is at most ``v``, held in 0..65535.

    Below 0 is 0, 0 is 1, and not a number is white. Levels are rounded to six places
    first, so noise below that doesn't choose the index.
    """
    r = F.round(F.when(F.isnan(v), 2.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(-1.0), v))) * MAX, 6)
    return F.when(r < 0, 0).otherwise(F.least(F.lit(MAX), F.floor(r).cast("int") + 1)).cast("int")


def whole(v: Column) -> Column:
    """A channel cut to a whole number in 0..65535; not a number and less than 0 are 0."""
    ok = F.when(F.isnan(v) | (v < 0), 0.0).otherwise(F.least(F.lit(float(MAX)), v))
    return F.floor(F.round(ok, 6)).cast("int")


def shift_rescale(c: Column, low: Column, high: Column) -> Column:
    """Linear scale to 65535; a flat range gives 0."""
    return whole(MAX * fdiv(c - low, high - low))


def shift_log_rescale(c: Column, low: Column, top: Column) -> Column:
    """Logarithmic scale to 65535 with ``top = ln(max - min)``."""
    return whole(MAX * fdiv(ln(c - low), top))


def normalize_gamma(px: DataFrame, values: list[Column], low: Column, high: Column, gamma: float = 1.8) -> DataFrame:
    """16-bit pixels of values scaled to 0..1, with gamma and inverse pixel mapping.

    Each step is a projection of its own, so that no step's code holds the others'
    more than once.
    """
    names = ["v0", "v1", "v2"]
    at = ["image_id", "x", "y"]
    px = px.select(*at, low.alias("low"), high.alias("high"), *[v.alias(n) for v, n in zip(values, names, strict=True)])
    px = px.select(*at, *[fdiv(F.col(n) - F.col("low"), F.col("high") - F.col("low")).alias(n) for n in names])
    px = px.select(*at, *[F.when(above(F.col(n), 0.0), F.pow(n, F.lit(1 / gamma))).otherwise(F.col(n)).alias(n) for n in names])
    return to_ldr(px, *[inverse_pixel_mapping(F.col(n)) for n in names])


def srgb(c: Column) -> Column:
    """The sRGB curve, to 65535; below its linear part 0."""
    curve = F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055).when(c >= -0.0031308, 12.92 * c).otherwise(0.0)
    return whole(MAX * curve)


def to_ldr(px: DataFrame, r: Column, g: Column, b: Column) -> DataFrame:
    """Opaque 16-bit pixels."""
    return px.select("image_id", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"), F.lit(MAX).alias("a"))

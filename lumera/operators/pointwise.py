"""Operators that look at one pixel, or at the same pixel of two images."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumera.functions.color import Triple, columns
from lumera.schema import CHANNELS, channels, f32


def log10_of(c: Column) -> Column:
    """log10, values below 1e-4 taken as 1e-4; not a number stays."""
    return F.log10(F.greatest(c, F.lit(1e-4)))


def pow10_of(c: Column) -> Column:
    """10 to the power of ``c``; exponents above 12 give 1."""
    return F.pow(F.lit(10.0), F.when((c > 12) & ~F.isnan(c), 0.0).otherwise(c))


def log10_filter(px: DataFrame) -> DataFrame:
    """:func:`log10_of` every channel."""
    return channels(px, *map(log10_of, columns()))


def pow10_filter(px: DataFrame) -> DataFrame:
    """:func:`pow10_of` every channel."""
    return channels(px, *map(pow10_of, columns()))


def apply1(px: DataFrame, f: Callable[[Column, Column, Column], Triple]) -> DataFrame:
    """A function of the three channel columns at every pixel."""
    return channels(px, *f(*columns()))


def apply2(a: DataFrame, b: DataFrame, f: Callable[[Triple, Triple], Triple], keys: tuple[str, ...] = ("image_id", "x", "y")) -> DataFrame:
    """A function of the channels of two images at each place that both have.

    Prefer one relation with both channel sets where there is one; this is an
    equi-join on the place.
    """
    other = b.select(*keys, *[F.col(c).alias(f"o{c}") for c in CHANNELS])
    return channels(a.join(other, list(keys)), *f(columns(), columns("oc1", "oc2", "oc3")))


def quick_sampling(px: DataFrame, share: float) -> DataFrame:
    """Rows ``int(y * share)`` of each image as rows y of an image of ``int(height * share)`` rows.

    Row numbers are cut from 32-bit products. Rows repeat, as several map to one.
    """
    if not 0 <= share <= 1:
        raise ValueError("the share lies between 0 and 1")
    single = lambda c: (c.cast("float") * F.lit(share).cast("float")).cast("int")
    heights = px.groupBy("image_id").agg((F.max("y") + 1).alias("height"))
    tall = heights.select("image_id", single(F.col("height")).alias("rows")).where("rows > 0")
    rows = tall.select("image_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("to_y"))
    wanted = rows.select("image_id", "to_y", single(F.col("to_y")).alias("y"))
    return px.join(wanted, ["image_id", "y"]).select("image_id", "x", F.col("to_y").alias("y"), *CHANNELS)


def row_weight(y: Column, height: Column, share: float) -> Column:
    """How often :func:`quick_sampling` takes row ``y`` of an image of ``height`` rows, by arithmetic alone.

    Row t of the sample is row ``int(t * share)``; the few t that may give y are tried.
    Exact for up to ten million rows.
    """
    if not 0 <= share <= 1:
        raise ValueError("the share lies between 0 and 1")
    if share == 0:
        return F.lit(0)
    single = lambda c: (c.cast("float") * F.lit(share).cast("float")).cast("int")
    first = F.floor(y / F.lit(share)).cast("int") - 2
    tried = [first + i for i in range(int(1 / share) + 6)]
    return reduce(add, [F.when((t >= 0) & (t < single(height)) & (single(t) == y), 1).otherwise(0) for t in tried])


def as_float32(px: DataFrame) -> DataFrame:
    """Channels as they are after storage in 32 bits."""
    return channels(px, *[f32(F.col(c)) for c in CHANNELS])

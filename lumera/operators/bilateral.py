"""Edge-preserving blur by a sparse bilateral grid.

Pixels are summed into the cells of a coarse grid over place and value, the grid is
smoothed, and each pixel reads the grid between cells. The grid is a relation of its
occupied cells. The cells that pixels lie in ask for the values at their corners, so
nothing else is smoothed along the last axis; they become one row a cell that holds all
of its corners, and pixels are joined once and neither multiplied nor grouped again.

Cells are as many as the pixels want, but take next to nothing in Parquet, so Spark would
guess by the size of their files that they can be broadcast, and fill the driver. Their
joins ask for a merge.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumera.functions.color import as_rgb, as_xyz, carried, of_xyz
from lumera.functions.ieee import fdiv
from lumera.schema import CHANNELS, attach, channels
from lumera.session import materialised

#: Empty cells on each side of the grid.
PADDING = 2


def _floor(c: Column) -> Column:
    return F.floor(c).cast("int")


def splat(px: DataFrame, stats: DataFrame, values: list[Column], axes: list[Column], sigma_space: Column) -> DataFrame:
    """Sums ``s1..`` of values and counts ``w`` of each occupied cell ``g0..``, with the grid's sizes ``n0..``.

    ``axes``: the coordinates on the value axes in units of their step; ``stats`` has
    ``sigma_space`` and the sizes, one row per image.
    """
    at = [F.col("x") / sigma_space, F.col("y") / sigma_space, *axes]
    keys = [(_floor(c + 0.5) + PADDING).alias(f"g{i}") for i, c in enumerate(at)]
    sizes = [f"n{i}" for i in range(len(at))]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(values, 1)]
    return attach(px, stats).groupBy("image_id", *sizes, *keys).agg(*sums, F.count(F.lit(1)).cast("double").alias("w"))


def smooth(grid: DataFrame, axes: int, sums: int, over: int | None = None) -> DataFrame:
    """Two passes of (1, 2, 1)/4 along each axis, or the first ``over``; what reaches the border of the grid is lost.

    Both passes of an axis are one step of five taps; a path by way of the border is
    left out of them.
    """
    names = [f"s{i}" for i in range(1, sums + 1)] + ["w"]
    tap = {-1: 0.25, 0: 0.5, 1: 0.25}
    for axis in range(axes if over is None else over):
        g, n = F.col(f"g{axis}"), F.col(f"n{axis}")
        taps = F.array(*[F.struct(F.lit(i).alias("mid"), F.lit(i + j).alias("to"), F.lit(tap[i] * tap[j]).alias("part")) for i, j in product(tap, tap)])
        inside = lambda c, n=n: c.between(1, n - 2)
        spread = grid.withColumn("t", F.explode(taps)).where(inside(g + F.col("t.mid")) & inside(g + F.col("t.to")))
        keys = [f"n{i}" for i in range(axes)] + [(g + F.col("t.to")).alias(f"g{i}") if i == axis else f"g{i}" for i in range(axes)]
        grid = spread.groupBy("image_id", *keys).agg(*[F.sum(F.col(c) * F.col("t.part")).alias(c) for c in names])
    return grid


def smooth_at(grid: DataFrame, wanted: DataFrame, axes: int, sums: int) -> DataFrame:
    """:func:`smooth` where only the cells ``wanted`` (image_id, g0..) are asked for.

    The last axis is read from the wanted cells' five neighbours in place of being sent
    from every occupied cell, so a grid that is finer than the pixels is never filled in.
    """
    names, last = [f"s{i}" for i in range(1, sums + 1)] + ["w"], axes - 1
    grid = smooth(grid, axes, sums, last)
    tap, g, n, d = {-1: 0.25, 0: 0.5, 1: 0.25}, F.col("target"), F.col(f"n{last}"), F.col("d")
    inside = lambda c: c.between(1, n - 2)
    part = reduce(lambda x, y: x + y, [F.when((d == i + j) & inside(g - j), tap[i] * tap[j]).otherwise(0.0) for i, j in product(tap, tap)])
    at = ["image_id", *[f"g{i}" for i in range(last)]]
    asked = wanted.select(*at, F.col(f"g{last}").alias("target"), F.explode(F.array(*map(F.lit, range(-2, 3)))).alias("d")).withColumn(f"g{last}", g - d)
    read = asked.join(grid.hint("merge"), [*at, f"g{last}"]).where(inside(g)).withColumn("part", part)
    return read.groupBy(*at, g.alias(f"g{last}")).agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in names])


def corner_cells(bases: DataFrame, axes: int) -> DataFrame:
    """The cells at the corners of the cells ``b0..``: image_id, b0.., k (place in the order of the corners' bits), g0.."""
    steps = list(product((0, 1), repeat=axes))
    at = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(s).alias(f"d{i}") for i, s in enumerate(step)]) for k, step in enumerate(steps)])
    spread = bases.select("*", F.explode(at).alias("c"))
    return spread.select("image_id", *[f"b{i}" for i in range(axes)], "c.k", *[(F.col(f"b{i}") + F.col(f"c.d{i}")).alias(f"g{i}") for i in range(axes)])


def corners(cells: DataFrame, grid: DataFrame, axes: int, names: list[str]) -> DataFrame:
    """For each cell ``b0..`` the values at its corners: arrays in the order of the corners' bits, 0 where empty."""
    found = cells.join(grid.hint("merge"), ["image_id", *[f"g{i}" for i in range(axes)]])
    pairs = F.map_from_entries(F.collect_list(F.struct("k", F.struct(*names))))
    held = found.groupBy("image_id", *[f"b{i}" for i in range(axes)]).agg(pairs.alias("m"))
    value = lambda n: F.transform(F.sequence(F.lit(0), F.lit(2**axes - 1)), lambda k: F.coalesce(F.col("m")[k].getField(n), F.lit(0.0)))
    return held.select("image_id", *[f"b{i}" for i in range(axes)], *[value(n).alias(f"v_{n}") for n in names])


def corner_weights(axes: int) -> Column:
    """Weights of the corners for the grid coordinates ``q0..``, in the corners' order."""
    part = [F.col(f"q{i}") - F.floor(f"q{i}") for i in range(axes)]
    return F.array(*[reduce(lambda a, b: a * b, [part[i] if s else 1 - part[i] for i, s in enumerate(step)]) for step in product((0, 1), repeat=axes)])


def interpolate(name: str) -> Column:
    """Multilinear reading of the corners in ``v_name`` by the weights in ``part``; 0 where there are none."""
    return F.coalesce(F.aggregate(F.zip_with(f"v_{name}", "part", lambda v, p: v * p), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))


def _sizes(space: Column, value_steps: list[Column]) -> list[Column]:
    place = [_floor(F.col("max_x") / space) + 1 + 2 * PADDING, _floor(F.col("max_y") / space) + 1 + 2 * PADDING]
    return [c.alias(f"n{i}") for i, c in enumerate(place + [_floor(v) + 1 + 2 * PADDING for v in value_steps])]


def _read(px: DataFrame, splatted: DataFrame, at: list[Column], sums: int, names: list[str], values: list[Column]) -> DataFrame:
    """Pixels with the smoothed ``values`` at the corners of the cell they lie in and their grid coordinates ``q0..``."""
    axes = len(at)
    placed = px.select("*", *[(c + PADDING).alias(f"q{i}") for i, c in enumerate(at)])
    placed = placed.select("*", *[_floor(F.col(f"q{i}")).alias(f"b{i}") for i in range(axes)])
    base = ["image_id", *[f"b{i}" for i in range(axes)]]
    cells = materialised(corner_cells(placed.select(*base).distinct(), axes), "cells")
    wanted = cells.select("image_id", *[f"g{i}" for i in range(axes)]).distinct()
    grid = smooth_at(splatted, wanted, axes, sums).select("image_id", *[f"g{i}" for i in range(axes)], *[v.alias(n) for v, n in zip(values, names, strict=True)])
    return placed.join(corners(cells, grid, axes, names).hint("merge"), base, "left").withColumn("part", corner_weights(axes))


def luminance_stats(px: DataFrame, model: str, sigma_space: float | Column | None, sigma_range: float | None) -> DataFrame:
    """Range of luminance, steps and grid sizes of each image. Unset steps: 16 pixels, a tenth of the range."""
    lum = as_xyz(model)[1]
    found = px.groupBy("image_id").agg(F.min(lum).alias("low"), F.max(lum).alias("high"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    space = F.lit(16.0) if sigma_space is None else F.lit(sigma_space) if isinstance(sigma_space, float | int) else sigma_space
    step = (F.col("high") - F.col("low")) * 0.1 if sigma_range is None else F.lit(float(sigma_range))
    found = found.withColumn("space", space).withColumn("step", step)
    return found.select("image_id", "low", "high", "space", "step", *_sizes(F.col("space"), [F.coalesce(fdiv(F.col("high") - F.col("low"), F.nullif("step", F.lit(0.0))), F.lit(0.0))]))


def splat_luminance(px: DataFrame, model: str, sigma_space=None, sigma_range=None, stats: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """The luminance grid before smoothing; ``stats`` if they are known."""
    stats = luminance_stats(px, model, sigma_space, sigma_range) if stats is None else stats
    lum = as_xyz(model)[1]
    depth = F.coalesce((lum - F.col("low")) / F.nullif("step", F.lit(0.0)), F.lit(0.0))
    return splat(px, stats, [lum], [depth], F.col("space"))


def y_fast_bilateral(px: DataFrame, model: str, sigma_space=None, sigma_range=None, keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: ANN001
    """The luminance bilateral filter: luminance is read from the grid, X and Z move with it.

    Cells are divided by their counts before they are read. A flat image is returned
    as it is. ``sigma_space`` may be a column of the largest coordinates ``max_x`` and
    ``max_y``. Columns in ``keep`` come along, so that the result needn't be joined.
    """
    stats = materialised(luminance_stats(px, model, sigma_space, sigma_range), "ranges")
    known = [c for c in carried(model) if c not in keep]
    placed = px.select("image_id", "x", "y", *known, *keep, *[v.alias(c) for v, c in zip(as_xyz(model), CHANNELS, strict=True)])
    placed = attach(placed, stats.select("image_id", "low", "space", "step"))
    depth = F.coalesce((F.col("c2") - F.col("low")) / F.nullif("step", F.lit(0.0)), F.lit(0.0))
    at = [F.col("x") / F.col("space"), F.col("y") / F.col("space"), depth]
    value = F.when(F.col("w") != 0, F.col("s1") / F.col("w")).otherwise(0.0)
    read = _read(placed, splat_luminance(px, model, stats=stats), at, 1, ["v"], [value])
    read = read.withColumn("base", F.when(F.col("step") == 0, F.col("c2")).otherwise(interpolate("v")))
    shift = F.col("c2") - F.col("base")
    out = (F.col("c1") - shift, F.col("base"), F.col("c3") - shift)
    out = of_xyz(model, out)
    return read.select("image_id", "x", "y", *keep, *[v.alias(c) for v, c in zip(out, CHANNELS, strict=True)])


def fast_bilateral(px: DataFrame, model: str, sigma_space: float = 16.0, sigma_range: float | None = None) -> DataFrame:
    """The bilateral filter over all three channels of RGB.

    Sums and counts are read from the grid and divided afterwards. A flat image is
    returned as it is.
    """
    px = channels(px, *as_rgb(model))
    names = ("c1", "c2", "c3")
    found = px.groupBy("image_id").agg(*[F.min(c).alias(f"low_{c}") for c in names], *[F.max(c).alias(f"high_{c}") for c in names], F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    step = (F.greatest(*[f"high_{c}" for c in names]) - F.least(*[f"low_{c}" for c in names])) * 0.1 if sigma_range is None else F.lit(float(sigma_range))
    found = found.withColumn("step", step).withColumn("space", F.lit(float(sigma_space)))
    safe = F.nullif("step", F.lit(0.0))
    stats = found.select("image_id", "space", "step", *[f"low_{c}" for c in names], *_sizes(F.col("space"), [F.coalesce((F.col(f"high_{c}") - F.col(f"low_{c}")) / safe, F.lit(0.0)) for c in names]))
    axes = [F.coalesce((F.col(c) - F.col(f"low_{c}")) / safe, F.lit(0.0)) for c in names]
    placed = attach(px, stats.select("image_id", "space", "step", *[f"low_{c}" for c in names]))
    kept = ["s1", "s2", "s3", "w"]
    splatted = splat(px, stats, [F.col(c) for c in names], axes, F.col("space"))
    read = _read(placed, splatted, [F.col("x") / F.col("space"), F.col("y") / F.col("space"), *axes], 3, kept, [F.col(c) for c in kept])
    read = read.select("image_id", "x", "y", *names, "step", interpolate("w").alias("weight"), *[interpolate(s).alias(f"sum_{s}") for s in ("s1", "s2", "s3")])
    smooth_ = [F.when(F.col("step") == 0, F.col(c)).otherwise(fdiv(F.col(f"sum_{s}"), F.col("weight"))) for c, s in zip(names, ("s1", "s2", "s3"), strict=True)]
    return channels(read, *smooth_)

"""Separable blurs as window frames over the rows and the columns of each image.

All are linear and treat channels alike, so they blur in whatever linear model the
pixels are in. Pixels beyond an edge repeat the edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumera.schema import CHANNELS, channels

LINES = {"x": "y", "y": "x"}


def _line(axis: str):  # noqa: ANN202
    """The window of the pixels of one row (axis x) or column (axis y), and edges over it."""
    line = Window.partitionBy("image_id", LINES[axis])
    whole = line.orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return line.orderBy(axis), whole


def _beyond(axis: str, radius: int, whole) -> tuple[Column, Column]:  # noqa: ANN001
    """How many places of the kernel lie before the first and behind the last pixel."""
    at = F.col(axis)
    last = F.max(axis).over(whole)
    return F.greatest(F.lit(0), radius - at), F.greatest(F.lit(0), at + radius - last)


def box_blur(px: DataFrame, radius: int, axis: str) -> DataFrame:
    """Mean of the ``2 radius + 1`` pixels about each one along an axis."""
    if radius == 0:
        return px
    line, whole = _line(axis)
    before, behind = _beyond(axis, radius, whole)
    frame = line.rowsBetween(-radius, radius)
    mean = lambda c: (F.sum(c).over(frame) + F.first(c).over(whole) * before + F.last(c).over(whole) * behind) / (2 * radius + 1)
    return channels(px, *[mean(c) for c in CHANNELS])


def box_sizes(sigma: float, boxes: int = 3) -> list[int]:
    """Odd box widths whose repeated means come near a Gaussian of deviation ``sigma``."""
    spread = 12 * sigma * sigma
    low = math.floor(math.sqrt(spread / boxes + 1))
    low -= low % 2 == 0
    n_low = math.floor((spread - boxes * (low * low + 4 * low + 3)) / (-4 * low - 4) + 0.5)
    return [low if i < n_low else low + 2 for i in range(boxes)]


def fast_gaussian(px: DataFrame, radius: int) -> DataFrame:
    """A Gaussian of deviation ``radius`` by three box passes in each direction.

    Passes along one axis commute with those along the other, so the rows are dealt
    out once for all horizontal passes and once for all vertical ones.
    """
    for axis in ("x", "y"):
        for width in box_sizes(radius):
            px = box_blur(px, (width - 1) // 2, axis)
    return px


def _box_lines(values: np.ndarray, radius: int) -> np.ndarray:
    """Box means along the second axis of ``values`` (lines x pixels x channels), edges repeated."""
    if not radius:
        return values
    padded = np.concatenate([np.repeat(values[:, :1], radius + 1, axis=1), values, np.repeat(values[:, -1:], radius, axis=1)], axis=1)
    sums = np.cumsum(padded, axis=1)
    return (sums[:, 2 * radius + 1 :] - sums[:, : values.shape[1]]) / (2 * radius + 1)


def _blurred_lines(values: np.ndarray, starts: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Lines of pixels, one after the other, blurred along themselves: those of equal length and radius at once."""
    out, sizes = np.empty_like(values), np.diff(np.append(starts, len(values)))
    kinds, kind = np.unique(np.stack([sizes, radii], axis=1), axis=0, return_inverse=True)
    for k, (size, radius) in enumerate(kinds.tolist()):
        at = starts[kind.ravel() == k][:, None] + np.arange(size)
        part = values[at]
        for width in box_sizes(radius):
            part = _box_lines(part, (width - 1) // 2)
        out[at] = part
    return out


def fast_gaussian_by(px: DataFrame, radius: str, names: tuple[str, ...] = CHANNELS, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`fast_gaussian` with the radius in a column, the same for all pixels of an image.

    The lines of an image are dealt to tasks once for each axis, so one plan serves
    images of all sizes; a task works on the whole lines of an Arrow batch at once and
    holds no more than that and an unfinished line. Returns image_id, x, y, the columns
    in ``keep``, ``radius`` and the blurred ``names``.
    """
    columns = ["image_id", "x", "y", *keep, radius, *names]
    px = px.select(*columns)

    def blurred(axis: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        other = LINES[axis]

        def begins(t: pa.Table) -> np.ndarray:
            image, at = t.column("image_id").combine_chunks().dictionary_encode().indices.to_numpy(), t.column(other).to_numpy()
            return np.append(0, np.flatnonzero((image[1:] != image[:-1]) | (at[1:] != at[:-1])) + 1)

        def lines(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            values = np.stack([t.column(n).to_numpy() for n in names], axis=1)
            values = _blurred_lines(values, starts, t.column(radius).to_numpy()[starts])
            arrays = [t.column(n).combine_chunks() for n in columns[: -len(names)]] + [pa.array(v) for v in values.T]
            return pa.RecordBatch.from_arrays(arrays, names=columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                starts = begins(pa.Table.from_batches([batch]))
                same = not held or (held[-1].column("image_id")[held[-1].num_rows - 1] == batch.column("image_id")[0] and held[-1].column(other)[held[-1].num_rows - 1] == batch.column(other)[0])
                if same and len(starts) == 1:
                    held.append(batch)  # a line goes on beyond this batch
                    continue
                cut = int(starts[-1])
                whole = pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])]) if held or cut else None
                if whole is not None:
                    yield lines(whole.combine_chunks(), begins(whole))
                held = [batch.slice(cut)]
            if held:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield lines(whole, begins(whole))

        return run

    for axis in ("x", "y"):
        lines = ["image_id", LINES[axis]]
        px = px.repartition(*lines).sortWithinPartitions(*lines, axis).mapInArrow(blurred(axis), px.schema)
    return px


def stack_blur(px: DataFrame, radius: int) -> DataFrame:
    """Triangular kernel ``radius + 1 - |k|`` along rows, then along columns."""
    return px if radius == 0 else _stack(_stack(px, radius, "x"), radius, "y")


def _stack(px: DataFrame, radius: int, axis: str) -> DataFrame:
    line, whole = _line(axis)
    before, behind = _beyond(axis, radius, whole)
    left, right = line.rowsBetween(-radius, 0), line.rowsBetween(1, radius)
    at = F.col(axis)

    def mean(c: str) -> Column:
        rising = F.sum(c).over(left) * (radius + 1 - at) + F.sum(F.col(c) * at).over(left)
        falling = F.coalesce(F.sum(c).over(right) * (radius + 1 + at) - F.sum(F.col(c) * at).over(right), F.lit(0.0))
        edges = F.first(c).over(whole) * (before * (before + 1) / 2) + F.last(c).over(whole) * (behind * (behind + 1) / 2)
        return (rising + falling + edges) / (radius + 1) ** 2

    return channels(px, *[mean(c) for c in CHANNELS])

"""Dense containers of pixels: tiles of 32-bit or 64-bit floats.

A tile is one row with the channels of a square of pixels in an array, row by row:
12 bytes a pixel in 32 bits, 24 in 64, against some 60 of a row for each pixel. Tiles
suit storage and whatever works on neighbourhoods in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumera.schema import CHANNELS, attach

#: Pixels along the side of a tile.
SIDE = 64
KINDS = {"f32": ("float", np.float32), "f64": ("double", np.float64)}


def to_tiles(px: DataFrame, storage: str = "f32", side: int = SIDE) -> DataFrame:
    """image_id, ty, tx, width, height (of the image), side, values: tile by tile, each a group of its own.

    Missing pixels are 0, tiles without any pixel have no row; of pixels that repeat a
    place one is taken. Other columns are ignored. An empty table gives no rows.
    """
    kind, dtype = KINDS[storage]
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    placed = attach(px.select("image_id", "x", "y", *CHANNELS), sizes)
    keys = ["image_id", "ty", "tx", "width", "height"]
    placed = placed.withColumn("ty", F.floor(F.col("y") / side).cast("int")).withColumn("tx", F.floor(F.col("x") / side).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, ty, tx, w, h = key
        values = np.zeros((min(side, int(h) - ty * side), min(side, int(w) - tx * side), 3), dtype)
        values[pdf["y"] - ty * side, pdf["x"] - tx * side] = pdf[list(CHANNELS)]
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "side": [side], "values": [values.ravel()]})

    return placed.groupBy(*keys).applyInPandas(run, f"image_id string, ty int, tx int, width int, height int, side int, values array<{kind}>")


def from_tiles(tiles: DataFrame) -> DataFrame:
    """The pixels of tiles, by built-in functions alone."""
    wide = F.least("side", F.col("width") - F.col("tx") * F.col("side"))
    each = tiles.select("image_id", "ty", "tx", "side", wide.alias("wide"), "values", F.explode(F.sequence(F.lit(0), (F.size("values") / 3).cast("int") - 1)).alias("i"))
    value = lambda c: F.get("values", F.col("i") * 3 + c).cast("double")
    x, y = F.col("tx") * F.col("side") + F.col("i") % F.col("wide"), F.col("ty") * F.col("side") + F.floor(F.col("i") / F.col("wide"))
    return each.select("image_id", x.cast("int").alias("x"), y.cast("int").alias("y"), *[value(c).alias(n) for c, n in enumerate(CHANNELS)])

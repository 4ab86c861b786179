"""Relations that stand for images.

pixels: image_id, x, y, c1, c2, c3 in the image's own colour model; ldr: image_id,
x, y, r, g, b, a in 0..65535; images: one row of metadata for each image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXELS = "image_id string, x int, y int, c1 double, c2 double, c3 double"
LDR = "image_id string, x int, y int, r int, g int, b int, a int"
IMAGES = "image_id string, width int, height int, color_model string, storage string, format string, metadata map<string,string>"
RGB, XYZ, RAW = "RGB", "XYZ", "RAW"
CHANNELS = ("c1", "c2", "c3")
#: Up to so many images their statistics are sent to every task.
BROADCAST_IMAGES = 20_000


def attach(px: DataFrame, stats: DataFrame, most: int = BROADCAST_IMAGES) -> DataFrame:
    """``px`` with the statistics of its image.

    Statistics have one row per image. Up to ``most`` rows they are broadcast, so the
    pixels aren't moved; beyond, the two are joined by a shuffle on the image.
    """
    few = stats.limit(most + 1).collect()
    if len(few) > most:
        return px.join(stats, "image_id")
    return px.join(F.broadcast(px.sparkSession.createDataFrame(few, stats.schema)), "image_id")


def f32(c: Column) -> Column:
    """What a channel is after storage as a 32-bit float."""
    return c.cast("float").cast("double")


def channels(px: DataFrame, *values: Column) -> DataFrame:
    """``px`` with new channels."""
    return px.select("image_id", "x", "y", *[v.alias(c) for v, c in zip(values, CHANNELS, strict=True)])


def clip_to_bounds(px: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels inside the bounds; those outside are neither read nor written."""
    return px.where(f"x BETWEEN 0 AND {width - 1} AND y BETWEEN 0 AND {height - 1}")


def offset_in_raster(x: Column, y: Column, width: Column) -> Column:
    """Row-major index of a pixel."""
    return y * width + x


def blank(images: DataFrame) -> DataFrame:
    """Zero pixels of every image of an images relation."""
    rows = images.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    cells = rows.select("image_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "y")
    return cells.select("*", *[F.lit(0.0).alias(c) for c in CHANNELS])


def describe_images(px: DataFrame, color_model: str, storage: str = "f64", fmt: str = "") -> DataFrame:
    """The images relation of pixels whose origin is (0, 0)."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).select(
        "*", F.lit(color_model).alias("color_model"), F.lit(storage).alias("storage"), F.lit(fmt).alias("format"), F.create_map().cast("map<string,string>").alias("metadata")
    )

"""Order statistics of each group without moving or sorting its values: exact ones, and ones of a stated error in one pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumera.schema import attach
from lumera.session import materialised

#: A window ranks at most so many values of a group; larger buckets are divided again.
RANKED = 50_000
#: Parts that a bucket is divided into.
PARTS = 4096


def _magnitude(v: Column) -> Column:
    """Buckets that never fall as ``v`` grows, 256 to each doubling: not a number is last."""
    size = F.least(F.floor(F.log2(F.when(v != 0, F.abs(v))) * 256), F.lit(400_000)) + 300_000
    return F.when(F.isnan(v), 1_000_000).when(v == 0, 0).when(v < 0, -size).otherwise(size)


def _chosen(counted: DataFrame, *keys: str) -> DataFrame:
    """The bucket of each group that holds place ``rest`` of its values, with the place inside the bucket."""
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("lo")) - F.col("n")
    inside = counted.withColumn("before", before).where("rest >= before AND rest < before + n")
    return inside.select(*keys, (F.col("rest") - F.col("before")).alias("rest"), "lo", "hi", "n")


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: str = "image_id") -> DataFrame:
    """For each group and name in ``shares``: the value at index ``int(share * n)`` of the sorted values.

    The index is held below n. Nulls are left out, and a group that has nothing else
    has no row. Values are counted by magnitude, so a few large ones don't crowd the
    others into one bucket. The bucket that the index falls into is divided into
    ``PARTS`` until it holds equal values or at most ``RANKED``; these are ranked.
    Each round is a scan in which only counts are shuffled.
    """
    values = df.select(F.col(by).alias("image_id"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = (F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    counted = values.groupBy("image_id", _magnitude(F.col("v")).alias("bucket")).agg(*ends).drop("bucket")
    counted = counted.withColumn("all", F.sum("n").over(Window.partitionBy("image_id")))
    wanted = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in shares]), F.array(*[F.lit(float(s)) for s in shares.values()]))).alias("name", "share")
    rest = F.least(F.floor(F.col("share") * F.col("all")), F.col("all") - 1)
    chosen = materialised(_chosen(counted.select("*", wanted).withColumn("rest", rest), "image_id", "name"), "magnitudes")
    while (chosen.where("lo < hi").agg(F.max("n")).first()[0] or 0) > RANKED:
        within = attach(values, chosen.where("lo < hi").drop("n")).where("v BETWEEN lo AND hi")
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS))
        counted = within.groupBy("image_id", "name", "rest", part.alias("part")).agg(*ends)
        done = chosen.where("NOT lo < hi").select("image_id", "name", "rest", "lo", "hi", "n")
        chosen = materialised(_chosen(counted, "image_id", "name").unionByName(done), "parts")
    within = attach(values, chosen.where("lo < hi").drop("n")).where("v BETWEEN lo AND hi")
    equal = within.groupBy("image_id", "name", "rest", "v").agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("image_id", "name").orderBy("v"))
    ranked = equal.withColumn("up_to", up_to).where("up_to > rest").groupBy("image_id", "name").agg(F.min("v").alias("v"))
    found = ranked.unionByName(chosen.where("NOT lo < hi").select("image_id", "name", F.col("lo").alias("v")))
    return found.groupBy(F.col("image_id").alias(by)).pivot("name", list(shares)).agg(F.min("v"))


def percentiles_within(df: DataFrame, value: str, shares: dict[str, float], error: float, by: str = "image_id") -> DataFrame:
    """:func:`percentiles` in one pass by a mergeable quantile sketch.

    The place of each result among the n sorted values of its group differs from
    ``share * n`` by at most ``error * n`` (and one place), whatever the values are; the
    sketch holds some 1 / error values a group. Nulls are left out; what is not a number
    is greater than all else.
    """
    if not 0 < error < 1:
        raise ValueError("the error lies between 0 and 1")
    values = df.select(F.col(by).alias(by), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    steps = F.lit(math.ceil(1 / error))
    return values.groupBy(by).agg(*[F.percentile_approx("v", F.lit(float(s)), steps).alias(name) for name, s in shares.items()])

"""Pixel relations made of the driver's tables by exact arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, image_id: str) -> list:
    return [F.lit(image_id).alias("image_id"), (F.col(key) % 50).cast("int").alias("x"), F.floor(F.col(key) / 50).cast("int").alias("y")]


def event_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB, 50 pixels wide: value, a number from the properties, and the time of day of each event."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        *_place("event_id", "ev"),
        F.col("value").alias("c1"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("c2"),
        (F.hour("ts") + F.minute("ts") / F.lit(60.0)).alias("c3"),
    )


def order_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XYZ, 50 pixels wide, near neutral: Y is the price of each order."""
    lum = F.col("o_totalprice") / 1000
    return _read(spark, sf_dir, "orders").select(
        *_place("o_orderkey", "ord"),
        (lum * (F.lit(0.90) + F.lit(0.01) * (F.col("o_orderkey") % 11))).alias("c1"),
        lum.alias("c2"),
        (lum * (F.lit(0.95) + F.lit(0.02) * (F.col("o_orderkey") % 13))).alias("c3"),
    )


def embedding_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB, 21 pixels wide: three squared coordinates of a vector make a pixel."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x"))
    at = lambda j: F.col("embedding")[F.col("x") * 3 + j].cast("double")
    return e.select(F.lit("emb").alias("image_id"), "x", F.col("vec_id").cast("int").alias("y"), *[(100 * (at(j) * at(j))).alias(f"c{j + 1}") for j in range(3)])


def embedding_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RGB image for each label of the vectors."""
    from pyspark.sql import Window

    vectors = _read(spark, sf_dir, "embeddings")
    rows = vectors.withColumn("vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    e = rows.select(F.col("label").cast("string").alias("image_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x"))
    at = lambda j: F.col("embedding")[F.col("x") * 3 + j].cast("double")
    return e.select("image_id", "x", F.col("vec_id").cast("int").alias("y"), *[(100 * (at(j) * at(j))).alias(f"c{j + 1}") for j in range(3)])


def black_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of :func:`embedding_batch`, the first of them all black, and black pixels in the others."""
    px = embedding_batch(spark, sf_dir)
    dark = (F.col("image_id") == "0") | ((F.col("x") + F.col("y")) % 17 == 0)
    return px.select("image_id", "x", "y", *[F.when(dark, 0.0).otherwise(F.col(c)).alias(c) for c in ("c1", "c2", "c3")])


def mixed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event image in RGB and the order image in XYZ, with each one's model in ``color_model``."""
    return event_image(spark, sf_dir).withColumn("color_model", F.lit("RGB")).unionByName(order_xyz(spark, sf_dir).withColumn("color_model", F.lit("XYZ")))

"""Tone mapping of image files as they arrive. An extension: the batch operators over a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumera.sources.images import decode_pixels, encode_png, write_files


def stream_files(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """A stream of (image_id, content) of the files that come to a folder."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_batch).schema("path string, modificationTime timestamp, length bigint, content binary")
    return files.load(folder).select(F.col("path").alias("image_id"), "content")


def tone_map_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame], codec: str | None = None, **trigger) -> StreamingQuery:  # noqa: ANN003
    """Write a PNG for each file that comes to ``folder``.

    Statistics are per image and a file is in one batch, so no state crosses batches.
    A batch that runs again after a failure writes the same files again.
    """

    def each(batch: DataFrame, _: int) -> None:
        write_files(encode_png(operator(decode_pixels(batch, codec))), out, "png").count()

    return stream_files(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Image files inside SQL: table functions for pixels and a function for headers.

After ``register(spark)``::

    SELECT * FROM decode_images(TABLE(SELECT path, content FROM files))
    SELECT f.path, p.* FROM files f, LATERAL decode_image(f.content) p
    SELECT path, image_header(content).width FROM files

``decode_images`` works in Arrow batches; its table has the images' ids and contents as
its first two columns. ``decode_image`` hands over rows one by one, as Spark has no Arrow
functions in lateral joins: it is for few or small images beside other columns. A null
content has no pixels and a null header.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumera.sources import images
from lumera.sources.rows import Memory, band_rows

ROWS = "x int, y int, c1 double, c2 double, c3 double, color_model string"
HEADER = "struct<format string, width int, height int, color_model string, metadata map<string,string>>"


def register(spark: SparkSession) -> None:
    """Make ``decode_image`` and ``image_header`` known to SQL, with the codecs of this moment."""
    known = dict(images.CODECS)

    def decoded(name: str, data: bytes) -> Iterator[pa.RecordBatch]:
        module = images._codec(data, None, known)[1]
        head, at = module.read_header(data)
        for y, values in module.iter_rows(Memory(data), head, at, 0, head["height"], 16 * band_rows(head["width"])):
            yield from images.pixel_batches(name, head, values, y, True)

    @F.arrow_udtf(returnType=f"image_id string, {ROWS}")
    class DecodeImages:
        def eval(self, files: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for name, data in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                if data is not None:
                    yield from decoded(name, data)

    @F.udtf(returnType=ROWS)
    class DecodeImage:
        def eval(self, content: bytes) -> Iterator[tuple]:
            if content is not None:
                for batch in decoded("", bytes(content)):
                    yield from zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)

    @F.arrow_udf(returnType=HEADER)
    def image_header(content: pa.Array) -> pa.Array:
        found = []
        for data in content.to_pylist():
            kind, module = (None, None) if data is None else images._codec(data, None, known)
            found.append(("", kind, {} if module is None else module.read_header(data)[0], None))
        batch = images.header_batch(found)
        names = ["format", "width", "height", "color_model", "metadata"]
        return pa.StructArray.from_arrays([batch.column(n) for n in names], names=names, mask=pa.array([f[1] is None for f in found]))

    spark.udtf.register("decode_images", DecodeImages)
    spark.udtf.register("decode_image", DecodeImage)
    spark.udf.register("image_header", image_header)

"""Image files as relations, and relations as image files.

Files are found by Spark's ``binaryFile`` reader, so any file system that Spark knows
will do; decoding runs in Arrow batches. Images are encoded band by band, each band in
a task of its own, and a file is the bytes of its bands in order. For large files, and
to write files, see :mod:`lumera.sources.formats`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.schema import CHANNELS, IMAGES, PIXELS, RGB, attach
from lumera.sources import hli, pfm, rgbe
from lumera.sources.errors import CodecError, FormatError, UnsupportedError
from lumera.sources.rows import BAND_PIXELS, Memory, band_order, band_rows

#: Codecs by name with the bytes that their files begin with; add one with ``CODECS[name] = (module, magics)``
#: (see :mod:`lumera.sources.rows`) before reading, writing or registering formats.
CODECS: dict[str, tuple[ModuleType, tuple[bytes, ...]]] = {"hdr": (rgbe, rgbe.MAGIC), "pfm": (pfm, (b"PF\n", b"pf\n")), "hli": (hli, (hli.MAGIC,))}
#: Rows of one Arrow batch of pixels.
BATCH = 100_000


def sniff(content: bytes, known: dict | None = None) -> str | None:
    """The codec whose files begin like ``content``."""
    return next((name for name, (_, magics) in (CODECS if known is None else known).items() if content.startswith(magics)), None)


def _codec(content: bytes, name: str | None, known: dict | None = None) -> tuple[str, ModuleType]:
    known = CODECS if known is None else known
    name = name or sniff(content, known)
    if name not in known:
        raise UnsupportedError("no codec knows this file")
    return name, known[name][0]


def header_batch(rows: list[tuple[str, str | None, dict, str | None]]) -> pa.RecordBatch:
    """The images relation, and an ``error``, of files with their codec, header and error."""
    found = []
    for name, kind, head, bad in rows:
        meta = {str(k): str(v) for k, v in (head.get("metadata") or {}).items()}
        meta |= {k: str(head[k]) for k in ("exposure", "scale", "raster_mode", "compression") if k in head}
        found.append((name, head.get("width"), head.get("height"), head.get("model"), None if bad else "f32", kind, list(meta.items()), bad))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
    names = ["image_id", "width", "height", "color_model", "storage", "format", "metadata", "error"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)


#: What opening a file counts as, in bytes.
OPEN = 256 << 10


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the place of a path or URI; Spark writes local ones with one slash."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


#: Files whose headers a task reads.
HEADERS = 500
#: Bytes of a file that are read first for its header.
FIRST = 4096


def read_head(f, module: ModuleType) -> tuple[dict, int]:  # noqa: ANN001
    """The header of a file and the place of its raster, reading no more than that takes (in doubling steps)."""
    size, n = f.size(), FIRST
    while True:
        begin = bytes(f.read_at(min(n, size), 0))
        try:
            head, at = module.read_header(begin)
            if at <= len(begin):
                return head, at
        except (CodecError, IndexError) as bad:
            if n >= size:
                raise bad if isinstance(bad, CodecError) else FormatError(str(bad)) from bad
        if n >= size:
            raise FormatError("the header does not end")
        n *= 2


def read_images(spark: SparkSession, path: str, codec: str | None = None, permissive: bool = False) -> DataFrame:
    """The images relation of the files at ``path``, of which only the first bytes are read.

    Spark lists the files; tasks of about HEADERS files open them by ``pyarrow.fs``. On
    a file system that pyarrow doesn't know, use :func:`decode_headers` on contents.
    ``permissive``: files that can't be read have a null size and an ``error``.
    """
    known = dict(CODECS)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"))
    tasks = max(1, -(-files.count() // HEADERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                store, place = located(name)
                with store.open_input_file(place) as f:
                    try:
                        kind, module = _codec(bytes(f.read_at(min(f.size(), 64), 0)), codec, known)
                        rows.append((name, kind, read_head(f, module)[0], None))
                    except CodecError as bad:
                        if not permissive:
                            raise
                        rows.append((name, None, {}, str(bad)))
            yield header_batch(rows)

    return files.repartition(tasks).mapInArrow(run, IMAGES + ", error string")


def decode_headers(files: DataFrame, codec: str | None = None, permissive: bool = False) -> DataFrame:
    """The images relation of a relation (image_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    kind, module = _codec(content, codec)
                    rows.append((name, kind, module.read_header(content)[0], None))
                except CodecError as bad:
                    if not permissive:
                        raise
                    rows.append((name, None, {}, str(bad)))
            yield header_batch(rows)

    return files.select("image_id", "content").mapInArrow(run, IMAGES + ", error string")


def read_pixels(spark: SparkSession, path: str, codec: str | None = None, with_model: bool = False) -> DataFrame:
    """The pixels of the files at ``path``; the path of a file is its image_id."""
    return decode_pixels(spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"), "content"), codec, with_model)


def pixel_batches(name: str, head: dict, values: np.ndarray, y0: int = 0, with_model: bool = False) -> Iterator[pa.RecordBatch]:
    """The pixels of the rows of a file from ``y0`` on."""
    w, flat = head["width"], values.reshape(-1, 3).astype(np.float64)
    for a in range(0, len(flat), BATCH):
        part = flat[a : a + BATCH]
        at = np.arange(a, a + len(part))
        columns = [pa.repeat(name, len(part)), pa.array((at % w).astype(np.int32)), pa.array((y0 + at // w).astype(np.int32)), *map(pa.array, part.T)]
        names = ["image_id", "x", "y", "c1", "c2", "c3"]
        if with_model:
            columns, names = [*columns, pa.repeat(head["model"], len(part))], [*names, "color_model"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def decode_pixels(files: DataFrame, codec: str | None = None, with_model: bool = False) -> DataFrame:
    """The pixels of a relation (image_id, content).

    ``with_model``: the colour model of each file as a column ``color_model``, which the
    operators take in place of a name when files differ.
    """
    known = dict(CODECS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                module, f = _codec(content, codec, known)[1], Memory(content)
                head, at = module.read_header(content)
                for y, values in module.iter_rows(f, head, at, 0, head["height"], 16 * band_rows(head["width"])):
                    yield from pixel_batches(name, head, values, y, with_model)

    return files.select("image_id", "content").mapInArrow(run, PIXELS + ", color_model string" * with_model)


#: Bytes of a file that one task decodes.
SPLIT = 32 << 20


def find_files(spark: SparkSession, path: str) -> DataFrame:
    """The files at ``path`` as Spark lists them, unread: image_id, length. Filter it to choose what is decoded."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"), "length")


def decode_files(files: DataFrame, codec: str | None = None, with_model: bool = True, split: int = SPLIT) -> DataFrame:
    """The pixels of a relation (image_id, length) of files, which tasks open by ``pyarrow.fs``.

    A file of more than ``split`` bytes is decoded by several tasks, each a range of its
    rows; small files share tasks. Files that a condition leaves out aren't opened.
    """
    known = dict(CODECS)
    parts = files.select("image_id", F.greatest(F.lit(1), F.ceil(F.col("length") / split)).cast("int").alias("parts"), F.least("length", F.lit(split)).alias("size"))
    parts = parts.select("image_id", "parts", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = parts.agg(F.count(F.lit(1)), F.sum(F.col("size") + OPEN)).first()
    tasks = max(1, min(found[0], -(-(found[1] or 0) // split)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part, n in zip(*(batch.column(c).to_pylist() for c in ("image_id", "part", "parts")), strict=True):
                store, place = located(name)
                with store.open_input_file(place) as f:
                    module = _codec(bytes(f.read_at(min(f.size(), 64), 0)), codec, known)[1]
                    yield from part_batches(f, module, name, part, n, with_model)

    dealt = parts.select("image_id", "part", "parts").repartition(tasks)
    return dealt.mapInArrow(run, PIXELS + ", color_model string" * with_model)


def part_batches(f, module: ModuleType, name: str, part: int, parts: int, with_model: bool, low: int = 0, high: int = 1 << 62) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The pixels of one of ``parts`` ranges of a file's rows, as far as they lie in ``low`` to ``high``."""
    head, at = read_head(f, module)
    begin, end = max(low, head["height"] * part // parts), min(high, head["height"] * (part + 1) // parts)
    for y, values in module.iter_rows(f, head, at, begin, end, 16 * band_rows(head["width"])):
        yield from pixel_batches(name, head, values, y, with_model)


BANDS = "image_id string, width int, height int, color_model string, per_band int, band int, content binary"


def encode_bands(px: DataFrame, codec: str, model: str | None = RGB, pixels: int = BAND_PIXELS, **options) -> DataFrame:  # noqa: ANN003
    """Encoded bands of rows of every image: image_id, width, height, color_model, per_band, band, content.

    A band is a group of its own, of ``per_band`` rows and about ``pixels`` pixels, so a
    large image is encoded by many tasks. Missing pixels are 0; a band without any pixel
    has no row, and what joins the bands fills it in. ``model`` None: each image's is in
    ``color_model``.
    """
    module, names = CODECS[codec][0], list(CHANNELS)
    px = px.withColumn("color_model", F.lit(model)) if model is not None else px
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    per_band = F.greatest(F.lit(1), F.floor(F.lit(pixels) / F.col("width"))).cast("int")
    sizes = sizes.withColumn("per_band", per_band)
    keys = ["image_id", "width", "height", "color_model", "per_band", "band"]
    placed = attach(px.select("image_id", "x", "y", "color_model", *names), sizes).withColumn("band", F.floor(F.col("y") / F.col("per_band")).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, h, kind, n, number = key[1:]
        values = np.zeros((min(int(n), int(h) - int(number) * int(n)), int(w), 3))
        values[pdf["y"] - int(number) * int(n), pdf["x"]] = pdf[names]
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "content": [module.rows(values, kind, **options)]})

    return placed.groupBy(*keys).applyInPandas(run, BANDS)


def in_file_order(bands: DataFrame, codec: str) -> DataFrame:
    """Bands with those of an image in one task, in the order of the file."""
    upwards = getattr(CODECS[codec][0], "UPWARDS", False)
    order = F.col("band") if not upwards else -F.col("band")
    return bands.repartition("image_id").sortWithinPartitions("image_id", order)


def file_pieces(module: ModuleType, rows: Iterator[dict], options: dict) -> Iterator[tuple[str, bool, bytes]]:
    """(image_id, whether a file begins, bytes) of bands in file order: heads, and zero rows for bands without pixels."""
    now, left = None, []

    def zeros(band: int) -> tuple[str, bool, bytes]:
        n = now["per_band"]
        blank = np.zeros((min(n, now["height"] - band * n), now["width"], 3))
        return now["image_id"], False, module.rows(blank, now["color_model"], **options)

    for r in rows:
        if now is None or r["image_id"] != now["image_id"]:
            yield from map(zeros, left)
            now, left = r, band_order(r["height"], r["per_band"], getattr(module, "UPWARDS", False))
            yield r["image_id"], True, module.head(r["width"], r["height"], r["color_model"], **options)
        if r["band"] not in left:
            raise FormatError(f"the bands of {r['image_id']} are out of order")
        while left[0] != r["band"]:
            yield zeros(left.pop(0))
        left.pop(0)
        yield r["image_id"], False, r["content"]
    if now is not None:
        yield from map(zeros, left)


def encode_images(px: DataFrame, codec: str, model: str | None = RGB, **options) -> DataFrame:  # noqa: ANN003
    """A relation (image_id, content) of encoded files; missing pixels are 0. Only encoded bytes of an image meet in a task."""
    module = CODECS[codec][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for image, begins, data in file_pieces(module, (r for b in batches for r in b.to_pylist()), options):
            if begins and held:
                yield pa.RecordBatch.from_pydict({"image_id": [name], "content": pa.array([b"".join(held)], pa.binary())})
                held = []
            name = image
            held.append(data)
        if held:
            yield pa.RecordBatch.from_pydict({"image_id": [name], "content": pa.array([b"".join(held)], pa.binary())})

    return in_file_order(encode_bands(px, codec, model, **options), codec).mapInArrow(run, "image_id string, content binary")


def _raster(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, len(names)))
    out[pdf["y"], pdf["x"]] = pdf[names]
    return out


def png_16(values: np.ndarray) -> bytes:
    """An RGBA PNG of 16 bits a channel."""
    h, w, _ = values.shape
    rows = np.zeros((h, 1 + 8 * w), np.uint8)
    rows[:, 1:] = values.astype(">u2").reshape(h, -1).view(np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def encode_png(ldr: DataFrame) -> DataFrame:
    """A relation (image_id, content) of PNG files of 16-bit pixels."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"image_id": [key[0]], "content": [png_16(_raster(pdf, ["r", "g", "b", "a"]))]})

    return ldr.groupBy("image_id").applyInPandas(run, "image_id string, content binary")


def write_files(encoded: DataFrame, folder: str, suffix: str, name: Column | None = None) -> DataFrame:
    """Write each file of (image_id, content) to ``folder``; returns image_id and path.

    Names are the image_id with other characters than letters, digits, ``-`` and
    ``_`` replaced, and a hash of it. A file is written under another name and
    renamed, so a task that runs twice leaves one file.
    """
    safe = F.concat(F.regexp_replace("image_id", "[^A-Za-z0-9_-]", "_"), F.lit("-"), F.hex(F.xxhash64("image_id"))) if name is None else name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for image, short, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = f"{root}/.{short}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{root}/{short}.{suffix}")
                paths.append((image, f"{folder}/{short}.{suffix}"))
            yield pa.RecordBatch.from_pydict({"image_id": [a for a, _ in paths], "path": [b for _, b in paths]})

    return encoded.select("image_id", safe.alias("name"), "content").mapInArrow(run, "image_id string, path string")

"""The codecs as formats of ``spark.read`` and ``df.write``: pixels of image files, or their headers alone.

After ``register(spark)``::

    spark.read.format("hdr").load("file:///photos")                            # pixels
    spark.read.format("pfm").option("headers", "true").load("hdfs:///maps")    # images
    spark.read.format("images").load("hdfs:///mixed")                          # pixels and color_model, codecs by magic
    save(px, "hdfs:///out", "hli", preset="3")                                 # image files
    px.write.format("hdr").mode("append").save("hdfs:///out")                  # the same, for images of a moderate size

*Reading.* Small files share a partition and large ones are cut into row ranges, by
their sizes alone: option ``split`` gives the bytes of a partition. A task reads the
header and passes over the rows before its own: by arithmetic in float maps, by a pass
over the runs in Radiance files, by unpacking in HLi files. Of headers only the first
bytes of a file are read. Conditions on ``image_id`` choose the files before any is
opened, conditions on ``y`` the rows. Folders are read with all that lies in them; names
that begin with ``.`` or ``_`` are left out.

*Writing.* Bands of rows are encoded by groups of their own; the task that a file is
dealt to joins them in order, holding one at a time. Files appear under their names when
all tasks have succeeded: they are written to a folder that begins with ``_`` and moved
by the commit; a failed task or job leaves none. ``append`` replaces files of the same
image, ``overwrite`` all files of the format in the folder. A file is named after its
image_id, with a hash of it.

Files are opened by ``pyarrow.fs``, so the path must be one that pyarrow reaches (local,
HDFS, S3); for any other file system of Spark's there is
:func:`lumera.sources.images.read_pixels`.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from lumera.schema import IMAGES, PIXELS, RGB
from lumera.sources import images
from lumera.sources.errors import CodecError, FormatError, UnsupportedError
from lumera.sources.rows import BAND_PIXELS

#: Pixels of unfinished images that a task holds when pixels rather than bands are written.
HELD_PIXELS = 64 << 20
MIXED = PIXELS + ", color_model string"


def list_files(path: str) -> list[tuple[str, int]]:
    """The files at ``path``, a file or a folder, with their sizes, in the order of their names."""
    store, root = images.located(path)
    start = path[: len(path) - len(root)] if path.endswith(root) else "file://"
    found = store.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    kept = [f for f in inside if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p)]
    return sorted((start + f.path, f.size) for f in kept)


def bundled(files: list[tuple[str, int]], split: int, whole: bool) -> list[list[tuple[str, int, int]]]:
    """Partitions of (path, part, parts): small files together, large ones in parts unless they are to stay ``whole``."""
    out, held, total = [], [], 0
    for path, size in files:
        parts = 1 if whole else max(1, -(-size // split))
        if parts > 1:
            out += [[(path, k, parts)] for k in range(parts)]
            continue
        cost = images.OPEN + (0 if whole else size)
        if held and total + cost > split:
            out.append(held)
            held, total = [], 0
        held.append((path, 0, 1))
        total += cost
    return out + [held] if held else out


class ImageReader(ds.DataSourceReader):
    """Reads ranges of rows, or headers, of the files that the conditions leave."""

    def __init__(self, codecs: dict, kind: str | None, options: dict) -> None:
        self.codecs, self.kind, self.path = codecs, kind, options["path"]
        self.headers = options.get("headers", "false").lower() == "true"
        self.permissive = options.get("permissive", "false").lower() == "true"
        self.split = int(options.get("split", images.SPLIT))
        self.wanted = options.get("pathglobfilter") or options.get("pathGlobFilter")
        low, _, high = options.get("rows", ":").partition(":")
        self.low, self.high = int(low or 0), int(high or 1 << 62)

    def partitions(self) -> list[ds.InputPartition]:
        files = [f for f in list_files(self.path) if self.wanted is None or fnmatch(f[0].rpartition("/")[2], self.wanted)]
        return [ds.InputPartition(p) for p in bundled(files, self.split, self.headers)] or [ds.InputPartition([])]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        found = []
        for path, part, parts in partition.value:
            store, place = images.located(path)
            with store.open_input_file(place) as f:
                try:
                    kind = self.kind or images.sniff(bytes(f.read_at(min(f.size(), 64), 0)), self.codecs)
                    if kind is None:
                        raise UnsupportedError("no codec knows this file")
                    module = self.codecs[kind][0]
                    if self.headers:
                        found.append((path, kind, images.read_head(f, module)[0], None))
                    else:
                        yield from images.part_batches(f, module, path, part, parts, self.kind is None, self.low, self.high)
                except CodecError as bad:
                    if not self.permissive:
                        raise
                    found.append((path, None, {"metadata": {"error": str(bad)}}, None))
        if self.headers and found:
            yield images.header_batch(found).drop_columns(["error"])


@dataclass
class Written(ds.WriterCommitMessage):
    """What a task wrote: image_id, temporary and final name of each file."""

    files: list[tuple[str, str, str]]


class ImageWriter(ds.DataSourceArrowWriter):
    """Writes bands in file order, or pixels, as image files."""

    def __init__(self, module: ModuleType, kind: str, options: dict, schema: StructType, overwrite: bool) -> None:
        self.module, self.kind, self.path, self.overwrite = module, kind, options["path"], overwrite
        self.model = options.get("color_model", RGB)
        self.options = module.codec_options(options)
        self.stage = f"_writing-{uuid.uuid4().hex}"
        self.bands = set(schema.names) >= {"image_id", "width", "height", "color_model", "per_band", "band", "content"}
        if not self.bands and not set(schema.names) >= {"image_id", "x", "y", "c1", "c2", "c3"}:
            raise FormatError("an image writer takes pixels or the bands of encode_bands")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = images.located(self.path)
        store.create_dir(f"{root}/{self.stage}", recursive=True)
        attempt, files, out = TaskContext.get().taskAttemptId(), [], None
        pieces = images.file_pieces(self.module, (r for b in iterator for r in b.to_pylist()), self.options) if self.bands else self._encoded(iterator)
        try:
            for image, begins, data in pieces:
                if begins:
                    if out is not None:
                        out.close()
                    name = f"{re.sub('[^A-Za-z0-9_-]', '_', image)[-80:]}-{hashlib.sha256(image.encode()).hexdigest()[:16]}.{self.kind}"
                    files.append((image, f"{self.stage}/{attempt}-{name}", name))
                    out = store.open_output_stream(f"{root}/{files[-1][1]}", compression=None)
                out.write(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def _encoded(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, bytes]]:
        """Whole files of pixels, which have to be in one task."""
        held: dict[str, list] = {}
        total = 0
        for batch in iterator:
            t = pa.Table.from_batches([batch]).to_pandas()
            total += len(t)
            if total > HELD_PIXELS:
                raise FormatError("too many pixels for one task: write what encode_bands gives, or use save")
            for key, part in t.groupby(["image_id", *(["color_model"] if "color_model" in t else [])]):
                held.setdefault(key, []).append(part[["x", "y", "c1", "c2", "c3"]].to_numpy(np.float64))
        for key, parts in held.items():
            v = np.concatenate(parts)
            x, y = v[:, 0].astype(int), v[:, 1].astype(int)
            values = np.zeros((y.max() + 1, x.max() + 1, 3))
            values[y, x] = v[:, 2:]
            yield key[0], True, self.module.encode(values, key[1] if len(key) > 1 else self.model, **self.options)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = images.located(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        twice = {image for image, _, _ in files} if len({name for _, _, name in files}) < len(files) else set()
        if twice:
            self.abort(messages)
            raise FormatError("an image's pixels lie in several tasks: write what encode_bands gives, or use save")
        new = {name for _, _, name in files}
        if self.overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File and f.extension == self.kind and f.base_name not in new and f.base_name[:1] not in "._":
                    store.delete_file(f.path)
        for _, part, name in files:
            store.move(f"{root}/{part}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove this job's own temporary folder."""
        store, root = images.located(self.path)
        if store.get_file_info(f"{root}/{self.stage}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.stage}")


def source(kind: str | None, codecs: dict) -> type[ds.DataSource]:
    """The format of a codec, or without a name that of files of any codec, read only."""
    codecs = dict(codecs)

    class ImageSource(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return kind or "images"

        def schema(self) -> str:
            headers = self.options.get("headers", "false").lower() == "true"
            return IMAGES if headers else PIXELS if kind else MIXED

        def reader(self, schema: StructType) -> ds.DataSourceReader:
            return ImageReader(codecs, kind, dict(self.options))

        def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
            if kind is None:
                raise UnsupportedError("name a codec to write images")
            return ImageWriter(codecs[kind][0], kind, dict(self.options), schema, overwrite)

    return ImageSource


def register(spark: SparkSession) -> None:
    """Make every codec, and ``images``, known to ``spark.read.format`` and ``df.write.format``."""
    for kind in (*images.CODECS, None):
        spark.dataSource.register(source(kind, images.CODECS))


def save(px: DataFrame, path: str, codec: str, model: str | None = RGB, mode: str = "append", pixels: int = BAND_PIXELS, **options: str) -> None:
    """Write images of any size: bands are encoded by many tasks, then joined. ``model`` None: from ``color_model``.

    ``options``: those of the codec (``rle``; ``preset``, ``metadata``, ...), as strings.
    """
    register(px.sparkSession)
    bands = images.encode_bands(px, codec, model, pixels, **images.CODECS[codec][0].codec_options(options))
    images.in_file_order(bands, codec).write.format(codec).options(**options).mode(mode).save(path)

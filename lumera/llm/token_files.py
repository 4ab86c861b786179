"""Token files: ids in fixed-width bit packing with block offsets.

A file holds the ids of a run of documents::

    magic "LTF2", bits u8, 3 zero bytes, ids per block u32   the head, 12 bytes
    blocks                                                   ids, least significant bit first
    document ids i64, their starts u64                       starts count ids of this file
    which document ids are null, one bit each                such an id is written as 0
    byte offset of each block u64
    documents u64, ids u64, blocks u64, magic                the tail, 28 bytes

Each id takes ``bits`` bits, the fewest that hold the vocabulary, and each block
starts on a byte, so a block is unpacked by numpy without its neighbours and any
range of ids is read from the blocks that cover it. Files are written block by
block by the tasks that encode; ``manifest.json`` lists them with the number of
ids before each.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.llm import tokens
from lumera.llm.common import parts_for, read_table, scratch, small, text_or_empty

MAGIC = b"LTF2"
BLOCK = 65_536
#: Documents of one file, about.
FILE_DOCS = 20_000
HEAD, TAIL = struct.Struct("<4sB3xI"), struct.Struct("<QQQ4s")


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold each id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, one after the other."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class TokenWriter:
    """Writes one token file; memory is bounded by a block, a document, and 16 bytes a document for the index."""

    def __init__(self, out, bits: int, block: int = BLOCK) -> None:
        self.out, self.bits, self.block = out, bits, block
        self.docs, self.starts, self.offsets, self.null = array("q"), array("Q"), array("Q"), array("b")
        self.n, self.at, self.held, self.held_n = 0, HEAD.size, [], 0
        out.write(HEAD.pack(MAGIC, bits, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, stop, self.block):
            data = pack(ids[i : min(i + self.block, stop)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.held_n = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(last=True)
        for values, kind in ((self.docs, "<i8"), (self.starts, "<u8")):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(np.packbits(np.array(self.null, dtype=bool)).tobytes())
        self.out.write(np.array(self.offsets, dtype="<u8").tobytes())
        self.out.write(TAIL.pack(len(self.docs), self.n, len(self.offsets), MAGIC))


class TokenFile:
    """Random access to a token file opened by ``pyarrow.fs``."""

    def __init__(self, handle) -> None:
        self.f = handle
        magic, self.bits, self.block = HEAD.unpack(handle.read_at(HEAD.size, 0))
        size = handle.size()
        n_docs, self.n, n_blocks, end = TAIL.unpack(handle.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token file, or cut short")
        flags = -(-n_docs // 8)
        at = size - TAIL.size - 16 * n_docs - flags - 8 * n_blocks
        index = handle.read_at(size - TAIL.size - at, at)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs)
        self.starts = np.frombuffer(index, "<u8", n_docs, 8 * n_docs).astype(np.int64)
        self.null = np.unpackbits(np.frombuffer(index, np.uint8, flags, 16 * n_docs), count=n_docs).astype(bool)
        self.offsets = np.append(np.frombuffer(index, "<u8", n_blocks, 16 * n_docs + flags).astype(np.int64), at)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.f.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts, base = [], int(self.offsets[first])
        for b in range(first, last + 1):
            n = min(self.block, self.n - b * self.block)
            parts.append(unpack(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id (None for null), start and token ids of every document, read about ``most`` ids at a time."""
        stops = np.append(self.starts[1:], self.n)
        i = 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(stops, self.starts[i] + most, side="right")))
            ids = self.read(int(self.starts[i]), int(stops[j - 1]))
            for k in range(i, j):
                yield None if self.null[k] else int(self.doc_ids[k]), int(self.starts[k]), ids[int(self.starts[k] - self.starts[i]) : int(stops[k] - self.starts[i])]
            i = j


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> dict:
    """Encode all texts, each followed by ``end_id``, into token files in ascending id order.

    Null texts count as empty and hold the end id alone. Rows with a null id come
    first and are read back with a null id; negative ids are ids like any other. Repeated rows are written as often as they come, ties of
    id in the order of a hash of their text, so that no id has to be in one file. Other columns are ignored. An empty table gives
    a manifest without documents. Each range of ids goes to one file, written under
    a temporary name and then renamed, so a task that runs twice leaves one file.

    Returns the manifest, which is also written to the folder.
    """
    spark = docs.sparkSession
    bits = id_bits(max(tokens.vocabulary_size(tokenizer), end_id + 1))
    end = np.array([end_id], dtype="<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"ids-{context.partitionId():06d}.ltf"
        part = f"{root}/.{name}.{context.taskAttemptId()}"
        with store.open_output_stream(part) as out:
            writer = TokenWriter(out, bits)
            for batch in small(batches):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in tokens.slices(texts):
                    for doc_id, found in zip(ids[a:b], tokens.encoder(tokenizer).encode(texts[a:b]), strict=True):
                        writer.add(doc_id, np.concatenate([np.frombuffer(found, "<u4"), end]))
            writer.close()
        if writer.docs:
            store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n]})
        else:
            store.delete_file(part)

    n = files or parts_for(docs.count(), FILE_DOCS, spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    made = (
        rows.repartitionByRange(n, "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .mapInArrow(write, "name string, n_docs long, n_ids long")
        .collect()
    )
    listed, before = [], 0
    for r in sorted(made, key=lambda r: r["name"]):
        listed.append({"name": r["name"], "docs": r.n_docs, "ids": r.n_ids, "before": before})
        before += r.n_ids
    manifest = {"bits": bits, "end_id": end_id, "ids": before, "files": listed}
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    """The manifest of a folder of token files."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of a folder: doc_id, start, n_tokens, ids_crc32, and their ids if asked for.

    Null ids are null again, repeated ids and rows come as often as they were written.
    A folder without documents gives no rows.
    """
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    rows: list = []
                    for doc_id, start, ids in TokenFile(f).documents():
                        raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
                        rows.append((doc_id, before + start, len(ids), zlib.crc32(raw), *([ids.astype(np.int32)] * with_ids)))
                        if len(rows) >= 2_000:
                            yield _batch(rows, with_ids)
                            rows = []
                    yield _batch(rows, with_ids)

    listed = [(f["name"], f["before"]) for f in read_manifest(folder)["files"]]
    files = spark.createDataFrame(listed, "name string, before long").repartition(max(1, len(listed)))
    return files.mapInArrow(read, kind)


def _batch(rows: list, with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back."""
    folder = scratch(spark, "tokens")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, tokens.default_tokenizer())
    return read_token_files(spark, folder)

"""Removal of repeated strings by bucket-pointer refinement of suffixes.

Every byte is removed that a string of ``LENGTH`` bytes covers which also starts
somewhere else in the corpus. A suffix array would say so: two suffixes that agree
on ``LENGTH`` bytes stand in one bucket of that depth. Buckets are built by
bucket-pointer refinement: suffixes first stand in the bucket of their leading q-gram;
a bucket is refined by sorting on the bucket numbers of later offsets, and the new
numbers replace the old ones, so that depth 8 gives 16, 16 gives 32, up to ``LENGTH``.

To spread that over tasks, every window of ``LENGTH`` bytes is represented by the
``Q``-gram of least identifier in it (its anchor, the leftmost of equals), so equal
windows share their anchor and the distance from it. Neighbouring windows with one
anchor form a run, about one for 70 bytes. Then

1. runs of one content in an anchor bucket become one row with their number; where
   there are several, they are repeated as a whole;
2. one run of each content goes to the task of its anchor bucket if that has other
   contents too, and the suffixes of all runs there are refined byte by byte;
3. anchor buckets of very many contents are spread by window instead, windows being
   keyed by the identifiers of depth ``Q`` at the offsets that make up ``LENGTH``.

Anchors, contents and spread windows are compared by identifiers of 64 bits within one
anchor bucket, so a chance agreement needs two independent ones. What is refined is
compared as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.llm.common import join_counted, read_table, small, stored, text_or_empty
from lumera.llm.shingles import U, mix

#: Length of a repeated string; length of the q-grams that make the first buckets (a power of two).
LENGTH, Q = 200, 64
#: Window starts of a long text that are handled at a time, counted from its beginning.
SEGMENT = 1 << 19
#: Anchor buckets of more contents than this are spread by window.
LOCAL = 4_000
#: Bits of the place in a key by which anchors are chosen.
PLACE = 21
FIRST = mix(np.arange(1, 257, dtype=U))


def identifiers(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifiers of depth ``depth``, a power of two, of every suffix that long."""
    ids, h = FIRST[data], 1
    while h < depth:
        ids = ids[: max(0, len(ids) - h)] * U(0x9E3779B97F4A7C15) + ids[h:] * U(0xC2B2AE3D27D4EB4F)
        ids ^= ids >> U(32)
        h *= 2
    return mix(ids)


def offsets(length: int) -> list[int]:
    """The later offsets whose identifiers of depth ``Q`` make up depth ``length``."""
    return [*range(0, length - Q, Q), length - Q]


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` neighbours."""
    low, h = keys, 1
    while 2 * h <= width:
        low = np.minimum(low[: len(low) - h], low[h:])
        h *= 2
    return np.minimum(low[: len(keys) - width + 1], low[width - h :])


def segments(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Batches of (text number, base) and bytes; long texts are cut at fixed places, with overlap."""
    names: list[tuple[int, int]] = []
    parts: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):
        for base in range(0, len(t) - length + 1, SEGMENT):
            part = t[base : base + SEGMENT + length - 1]
            if held and held + len(part) > 2 * SEGMENT:
                yield names, parts
                names, parts, held = [], [], 0
            names.append((i, base))
            parts.append(part)
            held += len(part)
    if names:
        yield names, parts


def runs(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: text number, first window, windows, anchor's distance, anchor id, content id."""
    width = length - Q + 1
    for names, parts in segments(texts, length):
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        begin = np.cumsum(sizes) - sizes
        ids = identifiers(data, Q)
        mask = U((1 << PLACE) - 1)
        keys = (ids & ~mask) | np.arange(len(ids), dtype=U)
        anchor = (window_minimum(keys, width) & mask).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
        start = np.arange(len(anchor))
        whole = start + length <= (begin + sizes)[owner]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        ends = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        n = ends - first + 1
        stop = ends + length
        content = mix(n.astype(U) + U(1))
        for k in range(0, 2 * length, Q):
            content = mix(content * U(0x9E3779B97F4A7C15) + ids[np.minimum(first + k, stop - Q)])
            if (first + k + Q >= stop).all():
                break
        own = owner[first]
        text, base = np.array([i for i, _ in names])[own], np.array([b for _, b in names])[own]
        yield text, first - begin[own] + base, n, anchor[first] - first, ids[anchor[first]].view(np.int64), content.view(np.int64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; the last seven places, which have fewer, come short."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(">u8").ravel().astype(U)


def _split(ids: np.ndarray, live: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Sort the suffixes of ``live`` on ``keys`` and give each the number of its new bucket; those that are still in company.

    A bucket's number is one more than what has been given before, so numbers of
    different depths never meet. ``ids`` is changed in place.
    """
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    bucket = np.cumsum(new)
    ids[live[order]] = ids[-1] + bucket
    ids[-1] += len(order)
    alone = new & np.append(new[1:], True)
    return np.sort(live[order[~alone]])


def refine(texts: list[bytes], windows: np.ndarray, length: int = LENGTH, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows that stand in a bucket of depth ``length`` with another: run number and place in the run.

    Bucket-pointer refinement of the suffixes of all runs. They begin in buckets of
    their first eight bytes, compared as they are. A bucket is then refined by sorting
    its suffixes on the bucket numbers of the suffixes ``depth`` further on, which
    doubles the depth; the new numbers replace the old ones, so the next sort uses what
    this one has found. Suffixes alone in their bucket keep its number and aren't
    sorted again. No hash is involved: what is left agrees byte by byte. ``trace``
    collects (depth, windows in company).
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = begin[run] + place
    end = np.repeat(begin + sizes, sizes)
    # The number given last is kept behind the numbers of the suffixes.
    ids = np.zeros(len(data) + 1, np.int64)
    is_window = np.zeros(len(data), bool)
    is_window[start] = True
    # A suffix that its run cuts short of the depth matters to no window; it is alone from then on.
    live = _split(ids, np.arange(len(data)), _words(data))
    depth = 8
    while True:
        live = live[live + depth <= end[live]]
        if trace is not None:
            trace.append((depth, int(is_window[live].sum())))
        if depth >= length:
            break
        step = min(depth, length - depth)
        if depth + step >= length:
            live = live[is_window[live]]
        live = live[live + step + depth <= end[live]]
        live = _split(ids, live, ids[live].astype(U) << U(32) | ids[live + step].astype(U))
        depth += step
    found = np.zeros(len(data), bool)
    found[live] = True
    company = found[start]
    return run[company], place[company]


def window_keys(bucket: np.ndarray, texts: list[bytes], windows: np.ndarray, distance: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifier of depth ``length`` of every window of the runs: run number, place in the run, identifier."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ids = identifiers(data, Q)
    run = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.repeat(np.cumsum(sizes) - sizes, windows) + place
    known = mix((distance[run] - place).astype(U))
    for at in offsets(length):
        known = mix(known * U(0xC2B2AE3D27D4EB4F) + ids[start + at])
    return run, place, known.view(np.int64)


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _frame(kinds: dict[str, pa.DataType], *columns) -> pa.RecordBatch:  # noqa: ANN002
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _some(runs_: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Lists of rows that hold about a megabyte of bytes (the last field)."""
    held, size = [], 0
    for r in runs_:
        held.append(r)
        size += len(r[-1])
        if size > 1 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row_no, lo, hi): spans of the texts that repeated strings cover, not yet joined.

    ``texts``: row_no, z (the text compressed).
    """
    if length < 2 * Q:
        raise ValueError(f"strings of {2 * Q} bytes or more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(("bucket", "content", "row_no", "lo", "shape"), pa.int64())
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            rows = batch.column(0).to_numpy()
            whole = [unzip(z.as_py()) for z in batch.column(1)]
            for text, first, n, distance, bucket, content in runs(whole, length):
                yield _frame(kinds, bucket, content, rows[text], first, n << 16 | distance)

    every = stored(texts.mapInArrow(find, "bucket long, content long, row_no long, lo long, shape long"), "runs")
    # Runs of one content are one row from here on, whatever their number; all columns of ``first`` are of one run.
    one = [F.first(c).alias(c) for c in ("row_no", "lo", "shape")]
    contents = stored(every.groupBy("bucket", "content").agg(F.count(F.lit(1)).alias("n"), *one), "contents")
    many = stored(contents.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_contents")).where("n_contents > 1"), "many")
    several = stored(contents.where("n > 1").select("bucket", "content", "n"), "several")
    windows = F.shiftright("shape", 16)
    whole = join_counted(every, several, ["bucket", "content"], "n").select("row_no", "lo", (F.col("lo") + windows - 1 + length).alias("hi"))
    chosen = (
        join_counted(contents, many, ["bucket"], "n_contents")
        .groupBy("row_no")
        .agg(F.collect_list(F.struct("bucket", "n", "n_contents", "lo", "shape")).alias("runs"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {**dict.fromkeys(("bucket", "n", "n_contents", "row_no", "lo", "shape"), pa.int64()), "bytes": pa.binary()}
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            for row_no, z, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = unzip(z.as_py())
                rows = [(r["bucket"], r["n"], r["n_contents"], row_no, r["lo"], r["shape"], text[r["lo"] : r["lo"] + (r["shape"] >> 16) - 1 + length]) for r in found]
                yield _frame(kinds, *zip(*rows, strict=True))

    pieces = texts.join(chosen, "row_no").select("row_no", "z", "runs").mapInArrow(
        cut, "bucket long, n long, n_contents long, row_no long, lo long, shape long, bytes binary"
    )
    pieces = stored(pieces, "pieces")

    def fields(rows: list[tuple]) -> tuple:
        bucket, n, _, _, lo, shape, data = zip(*rows, strict=True)
        shape = np.array(shape)
        return np.array(bucket), list(data), shape >> 16, shape & 0xFFFF, np.array(n), np.array(lo)

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(("row_no", "lo", "hi"), pa.int64())

        def buckets() -> Iterator[list[tuple]]:
            """Whole buckets, about a megabyte at a time."""
            held: list[tuple] = []
            size = 0
            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if size > 1 << 20 and r[0] != held[-1][0]:
                        yield held
                        held, size = [], 0
                    held.append(r)
                    size += len(r[-1])
            if held:
                yield held

        for rows in buckets():
            _, data, windows_, _, n, lo = fields(rows)
            run, place = refine(data, windows_, length)
            # Whole runs are known already, so only runs of one copy are told of.
            alone = n[run] == 1
            run, place = run[alone], place[alone]
            if not len(run):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)]))
            last = np.append(edge[1:], len(run)) - 1
            numbers = np.array([r[3] for r in rows])
            yield _frame(kinds, numbers[run[edge]], lo[run[edge]] + place[edge], lo[run[last]] + place[last] + length)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(("bucket", "window", "n", "row_no", "lo"), pa.int64())
        for batch in batches:
            for rows in _some(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                bucket, data, windows_, distance, n, lo = fields(rows)
                run, place, key = window_keys(bucket, data, windows_, distance, length)
                numbers = np.array([r[3] for r in rows])
                yield _frame(kinds, bucket[run], key, n[run], numbers[run], lo[run] + place)

    few = pieces.where(F.col("n_contents") <= LOCAL)
    local = few.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(refined, "row_no long, lo long, hi long")
    wide = pieces.where(F.col("n_contents") > LOCAL).mapInArrow(spread, "bucket long, window long, n long, row_no long, lo long")
    again = wide.groupBy("bucket", "window").agg(F.sum("n").alias("times")).where("times > 1").select("bucket", "window")
    spread_out = wide.where("n = 1").join(again, ["bucket", "window"], "left_semi").select("row_no", "lo", (F.col("lo") + length).alias("hi"))
    return whole.unionByName(local).unionByName(spread_out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Remove the bytes of each text that repeated strings of ``length`` bytes cover.

    Texts are UTF-8 bytes; null counts as empty; strings never cross documents.
    Texts shorter than ``length`` lose nothing. A string that starts twice in one
    document is repeated, and so is one in a repeated row: of equal rows none is
    spared. Strings are judged on the input, not on what is left. Other columns are
    ignored. An empty table gives no rows.

    Returns doc_id, n_bytes, kept (the remaining bytes), spans (array of start, end).
    """

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part in small(batches):
            z = pa.array([squeeze(t.encode()) for t in part.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), z], names=["doc_id", "row_no", "z"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), text_or_empty(docs[text_col]).alias("text"))
    texts = stored(rows.mapInArrow(zipped, "doc_id long, row_no long, z binary"), "texts")
    spans = repeated_spans(texts.select("row_no", "z"), length).groupBy("row_no").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sizes, kept, joined = [], [], []
                for z, found in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    text = unzip(z.as_py())
                    gone = join_spans([(s["lo"], s["hi"]) for s in found or []])
                    left = [0, *(b for _, b in gone)]
                    right = [*(x for x, _ in gone), len(text)]
                    sizes.append(len(text))
                    kept.append(b"".join(text[i:j] for i, j in zip(left, right, strict=True)))
                    joined.append([{"start": x, "end": y} for x, y in gone])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(joined, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    return texts.join(spans, "row_no", "left").select("doc_id", "z", "found").mapInArrow(take, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes removed from all documents."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct hashes of a text's word shingles, cut to
48 bits. Sketches of parts merge into the sketch of the whole, and two sketches
give estimates of resemblance and containment and, each, of the number of distinct
shingles. A text with at most ``k`` shingles is held exactly.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.llm.common import parts_for, read_table, small, text_or_empty
from lumera.llm.shingles import U, shingle_hashes, text_slices

#: Hashes of a sketch, words of a shingle, bits of a stored hash.
K, WORDS, BITS = 128, 5, 48
#: Groups that a task merges at a time.
HELD = 20_000


def sketches(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The sketch of each text: sorted distinct hashes."""
    out = []
    for h in shingle_hashes(texts, words):
        h = h >> U(64 - BITS)
        if len(h) > 8 * k:  # the k smallest distinct are most often among the 4k smallest
            few = np.unique(np.partition(h, 4 * k)[: 4 * k])
            h = few if len(few) >= k else np.unique(h)
        else:
            h = np.unique(h)
        out.append(h[:k])
    return out


def to_text(sketch: np.ndarray) -> str:
    """A sketch as base 64 of its 6-byte little-endian hashes."""
    raw = np.ascontiguousarray(sketch, "<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    return base64.b64encode(raw.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    """The sketch that :func:`to_text` wrote."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : BITS // 8] = raw
    return wide.view("<u8").ravel()


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of what the parts were made of."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, U)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard resemblance; two empty sketches are alike."""
    union = merge([a, b], k)
    if not len(union):
        return 1.0
    return float(np.isin(union, a, assume_unique=True)[np.isin(union, b, assume_unique=True)].sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / float(a[-1] + U(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; an empty ``a`` is contained."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge([a, b], k), k) / distinct(a, k))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, n_distinct of each row.

    Null texts count as empty; empty and blank texts have an empty fingerprint.
    Repeated rows have equal ones. An empty table gives no rows.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            found = [s for a, b in text_slices(list(map(len, texts))) for s in sketches(texts[a:b], k, words)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": [to_text(s) for s in found], "n_distinct": [distinct(s, k) for s in found]})

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(make, "doc_id long, fingerprint string, n_distinct double")


def merge_fingerprints(parts: DataFrame, by: str, k: int = K) -> DataFrame:
    """Fingerprints of the unions of groups: ``by``, fingerprint.

    Each task first merges what it holds of a group, so a large group sends at most
    a few sketches from each task; beyond ``HELD`` groups at a time a task sends what
    it has. A null ``by`` is a group, null fingerprints count as empty, repeated rows
    change nothing. An empty table gives no rows.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([to_text(s) for s in held.values()], pa.string())], names=[by, "fingerprint"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = from_text(text or "")
                held[key] = merge([held[key], new], k) if key in held else new
                if len(held) > HELD:
                    yield give()
                    held.clear()
        yield give()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sketch, any_ = None, np.zeros(0, U), False
        for batch in batches:
            for new, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if any_ and new != key:
                    yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([to_text(sketch)])], names=[by, "fingerprint"])
                    sketch = np.zeros(0, U)
                key, sketch, any_ = new, merge([sketch, from_text(text)], k), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([to_text(sketch)])], names=[by, "fingerprint"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows = parts.select(by, "fingerprint")
    kind, schema = to_arrow_type(rows.schema[by].dataType), rows.schema
    return rows.mapInArrow(local, schema).repartition(F.col(by)).sortWithinPartitions(by).mapInArrow(whole, schema)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two fingerprint columns."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([resemblance(from_text(p), from_text(q)) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(each, "double")(a, b)


def order_keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Pairs of an id and a hash as 16 bytes each, whose order is by falling id and rising hash."""
    sign = np.int64(-(1 << 63))
    both = np.stack([~ids.astype(np.int64) ^ sign, hashes.astype(np.int64) ^ sign], axis=1).view(np.uint64)
    return both.astype(">u8").view("S16").ravel()


def places(heads: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of each key, and for keys that begin a range the range before it (for the first the last), else -1.

    ``heads``: the first key of each range, in order.
    """
    at = np.searchsorted(heads, keys, side="right") - 1
    return at, np.where(heads[at] == keys, (at - 1) % len(heads), -1)


#: Documents of one range, about.
RANGE = 20_000


def with_next(docs: DataFrame, make, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``make(ids, texts, next_texts)`` to blocks of documents in falling id order.

    The next of the last document is the first. Spark sorts ids and hashes of texts into
    ranges of about ``RANGE`` documents; their first ones (16 bytes a range) go to the tasks as an
    array, not into the plan. Texts then go straight to their ranges, and the first of
    each range also to the range before it, where it only serves as next. Null ids
    come last, repeated ids in the order of their text's hash, so an id that holds
    many documents, as null may, is split over ranges; rows that repeat as a whole
    follow each other in one range, which streams them. Null texts count as empty. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(low)).alias("sort_id"), text_or_empty(docs[text_col]).alias("text")).withColumn("h", F.xxhash64("text"))
    n = parts_for(docs.count(), RANGE, spark)
    ranges = rows.select("sort_id", "h").repartitionByRange(n, F.desc("sort_id"), "h").withColumn("range", F.spark_partition_id())
    first = ranges.groupBy("range").agg(F.min(F.struct((-1 - F.col("sort_id")).alias("falling"), "h")).alias("head")).select("head.*")
    found = first.toPandas()
    heads = np.sort(order_keys(-1 - found["falling"].to_numpy("int64"), found["h"].to_numpy("int64")))

    def place(ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        at, guest = places(heads, order_keys(ids.to_numpy(), hashes.to_numpy()))
        return pd.DataFrame({"own": at, "other": guest})

    placed = rows.withColumn("at", F.pandas_udf(place, "own int, other int")("sort_id", "h"))
    at = lambda place, guest: F.struct(place.alias("place"), F.lit(guest).alias("guest"))
    own, other = at(F.col("at.own"), 0), at(F.col("at.other"), 1)
    both = F.when(F.col("at.other") >= 0, F.array(own, other)).otherwise(F.array(own))
    dealt = placed.select("sort_id", "text", "h", F.explode(both).alias("at")).select("sort_id", "text", F.col("at.place").alias("place"), F.col("at.guest").alias("guest"), "h")
    order = [F.col("place"), F.col("guest"), F.desc("sort_id"), F.col("h")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        nexts: list[str] = []
        last, held = None, 0  # last: (id, text, place) still without its next
        for batch in small(batches):
            for sort_id, text, at, is_guest in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if last is not None and last[2] == at:
                    ids.append(None if last[0] == low else last[0])
                    texts.append(last[1])
                    nexts.append(text)
                    held += len(last[1])
                last = None if is_guest else (sort_id, text, at)
                if held > 1_000_000:
                    yield make(ids, texts, nexts)
                    ids, texts, nexts, held = [], [], [], 0
        if ids:
            yield make(ids, texts, nexts)

    return dealt.repartitionById(n, F.col("place")).sortWithinPartitions(*order).mapInArrow(walk, schema)


def _edited(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    """Fingerprints of texts and of their edited texts, and how alike they are."""
    cut = [len(t) // 3 for t in texts]
    edited = [t[: len(t) - c] + x[:c] for t, c, x in zip(texts, cut, nexts, strict=True)]
    raw = [[t.encode() for t in group] for group in (texts, edited, nexts)]
    own, new = (sketches(group) for group in raw[:2])
    # The next text is most often the following one of this block.
    after = [own[i + 1] if i + 1 < len(own) and nexts[i] is texts[i + 1] else sketches([raw[2][i]])[0] for i in range(len(own))]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw[1]],
            "fingerprint": [to_text(s) for s in own],
            "edited_fingerprint": [to_text(s) for s in new],
            "near_edited": [resemblance(a, b) for a, b in zip(own, new, strict=True)],
            "near_next": [resemblance(a, b) for a, b in zip(own, after, strict=True)],
        }
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, compared with their edited texts and their next documents."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(read_table(spark, sf_dir, "documents"), _edited, schema)

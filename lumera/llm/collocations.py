"""Phrases that occur together more often than their parts would: counted in two passes, scored, subsumed.

The first pass fills count-min sketches of all phrases of up to so many words, task by
task, and merges them; an estimate is never too low. The second pass counts exactly
what every row of the sketch lets through (and whose parts it lets through, as a part
is at least as frequent as the whole), so nothing frequent is lost and rare phrases,
which are nearly all, are never grouped. Texts are worked on as bytes.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumera.llm.common import join_counted, read_table, scratch, stored, text_or_empty, trim
from lumera.llm.shingles import U, mix

#: Rows of the sketch, and the least and greatest number of counters of a row (powers of two), a byte each.
DEPTH, NARROW, WIDE = 2, 1 << 16, 1 << 26
#: Counters of one piece of the sketch, the unit of merging.
PIECE = 1 << 20
#: Words, and different words, after which a task counts what it has read.
BATCH_WORDS, BATCH_VOCABULARY = 1_000_000, 200_000
#: Bytes of a text that are cut into words at a time.
WINDOW = 1 << 20
#: Tasks of the first pass for each core: each sends a sketch.
TASKS = 4
#: Fixed values of the contract: what ends a piece of text, and what stands between words.
ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: UTF-8 has no byte FF, so it can stand for an end.
END = b"\xff"
PLAIN = bytes.maketrans(ENDS + GAPS, END * len(ENDS) + b" " * len(GAPS))


class Words:
    """Numbers of the words of some texts of one language, 0 at each end of a piece.

    ``seen``: so many numbers at the beginning were counted before; they are here for
    the phrases that begin in them and end later.
    """

    def __init__(self, before: list[bytes] | None = None) -> None:
        self.vocabulary: dict[bytes, int] = {END: 0}
        self.ids = array("i", [0])
        self._extend(before or [])
        self.seen = len(self.ids)

    def _extend(self, words: list[bytes]) -> None:
        v = self.vocabulary
        self.ids.extend([v.setdefault(w, len(v)) for w in words])

    def add(self, text: bytes, a: int) -> int:
        """Take up a plain text from byte ``a`` to about WINDOW bytes further, where a word ends; returns that place."""
        b = a + WINDOW
        if b < len(text):
            b = next((i for i in (text.rfind(b" ", a, b), text.find(b" ", b)) if i > a), len(text))
        self._extend(text[a:b].split())
        if b >= len(text):
            self.ids.append(0)
        return b

    def full(self) -> bool:
        return len(self.ids) > BATCH_WORDS or len(self.vocabulary) > BATCH_VOCABULARY

    def last(self, n: int) -> list[bytes]:
        names = list(self.vocabulary)
        return [names[i] for i in self.ids[-n:]] if n else []


def plain(text: bytes) -> bytes:
    """Small letters for A-Z, gaps as spaces, ends as words of their own."""
    return text.lower().translate(PLAIN).replace(END, b" \xff ")  # bytes.lower() changes A-Z alone


def _word_hashes(words: list[bytes], seed: bytes) -> np.ndarray:
    """64-bit hashes of words; the sketch alone depends on them, not the results."""
    base = zlib.crc32(seed)
    low = np.fromiter((zlib.crc32(w, base) for w in words), np.uint64, len(words))
    high = np.fromiter((zlib.adler32(w) for w in words), np.uint64, len(words))
    return mix(low | mix(high ^ U(base)) << U(32))


def languages(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, Words]]:
    """The words of (lang, text), language by language, in portions that fit in memory.

    A long text goes through several portions; each begins with the last words of the
    one before.
    """
    held: dict[str, Words] = {}
    total = 0
    for batch in batches:
        for at in range(batch.num_rows):
            lang, text, a = batch.column(0)[at].as_py(), plain(batch.column(1)[at].as_py()), 0
            while True:
                words = held.setdefault(lang, Words())
                before = len(words.ids)
                a = words.add(text, a)
                total += len(words.ids) - before
                if words.full():
                    total -= len(words.ids)
                    yield lang, held.pop(lang)
                    if a < len(text):
                        held[lang] = Words(words.last(longest - 1))
                if a >= len(text):
                    break
            if total > 2 * BATCH_WORDS or len(held) > 1_000:
                yield from held.items()
                held, total = {}, 0
    yield from held.items()
    trim()


def phrases(lang: str, words: Words, longest: int, keep=None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:  # noqa: ANN001
    """For each number of words k: the hash of what begins at each word, the starts of all phrases, the word numbers.

    ``keep(k, hashes)`` tells which occurrences go on to longer phrases; a phrase goes
    on only if the phrases that it begins and ends with do.
    """
    ids = np.frombuffer(words.ids, np.int32)
    each = _word_hashes(list(words.vocabulary), lang.encode())[ids]
    hashes, live = mix(each ^ U(1)), ids != 0
    for k in range(1, longest + 1):
        if k > 1:
            live = np.append(live[:-1] & live[1:], False)
            following = np.append(each[k - 1 :], np.zeros(k - 1, U))
            hashes = mix(hashes * U(0x9E3779B97F4A7C55) + following)
        at = np.flatnonzero(live)
        if keep is not None and len(at):
            at = at[keep(hashes[at])]
            live = np.zeros(len(ids), bool)
            live[at] = True
        yield k, hashes, at, ids


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of each hash in a row of the sketch."""
    return (mix(hashes + U((row + 1) * 0xD6E8FEB86659FD93 % 2**64)) & U(width - 1)).astype(np.int64)


def sketch_width(occurrences: int, least: int) -> int:
    """Counters of a row: enough that chance fills few of them to ``least``, within NARROW and WIDE."""
    wanted = max(1, 4 * occurrences // least)
    return min(WIDE, max(NARROW, 1 << (wanted - 1).bit_length()))


def sketch(texts: DataFrame, longest: int, least: int, width: int) -> DataFrame:
    """Merged sketch as bits: which counters reach ``least``. One row a piece: row, piece, bits.

    Counters stop at ``least``, which is all that is asked of them. Every task sends
    its non-empty pieces, compressed; pieces are merged by Spark, each in one task
    that holds PIECE counters whatever the number of tasks.
    """
    top = min(least, 255)
    scale = -(-least // top)  # a counter of one byte stands for so many; rounded up, so never too low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((DEPTH, width), np.uint8)
        for lang, words in languages(batches, longest):
            for k, hashes, at, _ in phrases(lang, words, longest):
                found, n = np.unique(hashes[at[at + k > words.seen]], return_counts=True)
                n = np.minimum(-(-n // scale), top)
                for row in range(DEPTH):
                    # Cells in order, with what falls into each summed up before it is added and held at ``top``.
                    keyed = np.sort(cells(found, row, width) << 8 | n)
                    first = np.flatnonzero(np.diff(keyed >> 8, prepend=-1))
                    if len(first):
                        at_cell = keyed[first] >> 8
                        counts[row][at_cell] = np.minimum(counts[row][at_cell] + np.add.reduceat(keyed & 255, first), top)
        pack = zstandard.ZstdCompressor(level=1)
        for row in range(DEPTH):
            for a in range(0, width, PIECE):
                part = counts[row, a : a + PIECE]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "piece": pa.array([a // PIECE], pa.int32()), "counts": pa.array([pack.compress(part.tobytes())], pa.binary())})
        del counts
        trim()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(min(PIECE, width), np.int64)
        for batch in batches:
            for data in batch.column("counts"):
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), np.uint8)
        bits = np.packbits(total * scale >= least).tobytes()
        yield pa.RecordBatch.from_pydict({"row": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

    spark = texts.sparkSession
    parts = texts.coalesce(max(1, TASKS * spark.sparkContext.defaultParallelism))
    sent = parts.mapInArrow(run, "row int, piece int, counts binary")
    return sent.groupBy("row", "piece").applyInArrow(merge, "row int, piece int, bits binary")


@lru_cache(maxsize=1)
def _loaded(path: str, width: int) -> np.ndarray:
    """The bits of a sketch, one row each, as booleans packed in bytes; kept by the worker."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(root) as f:
        return np.frombuffer(f.read(), np.uint8).reshape(DEPTH, width // 8)


def _stored_bits(found: DataFrame, width: int) -> str:
    """The bits of all pieces in one file of the shared folder, DEPTH * width / 8 bytes: 16 MB at most."""
    bits = np.zeros((DEPTH, width // 8), np.uint8)
    size = min(PIECE, width) // 8
    for r in found.toLocalIterator():
        bits[r.row, r.piece * size : (r.piece + 1) * size] = np.frombuffer(r.bits, np.uint8)
    path = scratch(found.sparkSession, f"sketch-{uuid.uuid4().hex}.bits")
    store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    store.create_dir(root.rpartition("/")[0], recursive=True)
    with store.open_output_stream(root) as out:
        out.write(bits.tobytes())
    return path if "://" in path else f"file://{path}"


def count_phrases(docs: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of up to ``longest`` words that occur ``least`` times in a language, and the words of each.

    A-Z become small letters; ``.,;:!?`` and the controls 0A to 0D end a piece, space
    and tab part words, and phrases lie within a piece. Overlapping occurrences count,
    repeated rows too. A null language is ``und``, a null text empty; an empty table
    gives no rows. Other columns are ignored. ``width`` only sets how many rare phrases
    are counted in vain.

    Returns (lang, words, phrase, f) and (lang, n).
    """
    least = max(1, least)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), text_or_empty(docs[text_col]).cast("binary").alias("text"))
    if width is None:
        # About one word for five bytes; the width needn't be exact.
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        width = sketch_width(longest * size // 5, least)
    path = _stored_bits(sketch(texts, longest, least, width), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _loaded(path, width)

        def keep(hashes: np.ndarray) -> np.ndarray:
            found = np.ones(len(hashes), bool)
            for row in range(DEPTH):
                at = cells(hashes, row, width)
                found &= (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            return found

        for lang, words in languages(batches, longest):
            names = np.array(list(words.vocabulary), dtype=object)
            same = np.zeros(len(words.ids), np.int64)  # number of the phrase that begins here
            for k, _, at, ids in phrases(lang, words, longest, keep):
                if k == 1:
                    total = int(np.count_nonzero(ids[words.seen :]))
                    yield _counted(lang, 0, [b""], [total])
                if not len(at):
                    continue
                # A phrase is the number of its first words and its last word: exact, no hash decides.
                key = same[at] * np.int64(len(names)) + ids[at + k - 1]
                _, first, number = np.unique(key, return_index=True, return_inverse=True)
                same = np.zeros(len(ids), np.int64)
                same[at] = number
                counts = np.bincount(number[at + k > words.seen], minlength=len(first))
                begins, counts = at[first][counts > 0], counts[counts > 0]
                texts = names[ids[begins]]
                for j in range(1, k):
                    texts = texts + b" " + names[ids[begins + j]]
                for a in range(0, len(texts), 50_000):
                    yield _counted(lang, k, texts[a : a + 50_000].tolist(), counts[a : a + 50_000])
        trim()

    kind = "lang string, words int, phrase string, f long"
    counted = stored(texts.mapInArrow(run, kind).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("words").isin(0) | (F.col("f") >= least)), "phrases")
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("f").alias("n"))


def _counted(lang: str, k: int, texts: list[bytes], counts) -> pa.RecordBatch:  # noqa: ANN001
    arrays = [pa.array([lang] * len(texts), pa.string()), pa.array([k] * len(texts), pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "words", "phrase", "f"])


def score_phrases(counts: DataFrame) -> DataFrame:
    """Candidates of two words or more with their weakest cut: lang, words, phrase, a, l, r, score.

    Cutting a phrase of frequency a into parts of frequencies l and r scores
    floor(1,000,000 a² / (l r)); the cut of least score counts, of equal ones that
    with the shortest first part. Decimals of 38 digits hold all products up to
    a = 9·10^15. Parts of a candidate are at least as frequent as it, so each has a row
    in ``counts``. Frequent parts, which many candidates share, are dealt out.
    """
    word = F.split("phrase", " ")
    many = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), word.alias("w"))
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = many.select("lang", "words", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = [("l", joined(F.lit(1), F.col("k"))), ("r", joined(F.col("k") + 1, F.col("words") - F.col("k")))]
    both = F.array(*[F.struct(F.lit(side).alias("side"), part.alias("part")) for side, part in sides])
    cuts = cuts.select("lang", "words", "phrase", "a", "k", F.explode(both).alias("p"))
    cuts = stored(cuts.select("lang", "words", "phrase", "a", "k", "p.side", "p.part"), "cuts")
    asked = cuts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n_cuts"))
    parts = stored(counts.select("lang", F.col("phrase").alias("part"), "f").join(asked, ["lang", "part"]), "parts")
    known = join_counted(cuts, parts, ["lang", "part"], "n_cuts")
    whole = known.groupBy("lang", "words", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    exact = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = whole.withColumn("score", exact.cast("long"))
    weakest = scored.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def drop_subsumed(candidates: DataFrame, counts: DataFrame, percent: int = 50) -> DataFrame:
    """Candidates whose words don't lie inside a longer phrase that occurs ``percent`` hundredths as often.

    A longer phrase counts whether or not it is dropped itself. ``counts`` has all
    phrases that can be candidates.
    """
    longer = counts.where("words > 2").select("lang", "words", "f", F.split("phrase", " ").alias("w"))
    inside = longer.select("lang", "f", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    most = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    both = candidates.join(most, ["lang", "phrase"], "left")
    return both.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, most: int = 2_000, lang_col: str = "lang", text_col: str = "text", width: int | None = None) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    By score, then frequency, falling, then the phrase's bytes. See
    :func:`count_phrases` for nulls, repeated rows and empty tables.
    """
    counts, totals = count_phrases(docs, longest, least, lang_col, text_col, width)
    kept = drop_subsumed(score_phrases(counts), counts, percent)
    # Spark cuts each partition to its first rows of a language before it deals them by language.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language of all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0
), f1 AS (
  SELECT lang, w[i] AS p, count(*) AS f FROM placed GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), f2 AS (
  SELECT lang, w[i] AS a1, w[i + 1] AS a2, count(*) AS f FROM placed WHERE i + 1 <= len(w) GROUP BY ALL
), f3 AS (
  SELECT lang, w[i] AS a1, w[i + 1] AS a2, w[i + 2] AS a3, count(*) AS f FROM placed WHERE i + 2 <= len(w) GROUP BY ALL
), cuts AS (
  SELECT c.lang, a1 || ' ' || a2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.p = a1 JOIN f1 y ON y.lang = c.lang AND y.p = a2 WHERE c.f >= 10
  UNION ALL
  SELECT c.lang, c.a1 || ' ' || c.a2 || ' ' || c.a3, c.f, 1, x.f, y.f
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.p = c.a1 JOIN f2 y ON y.lang = c.lang AND y.a1 = c.a2 AND y.a2 = c.a3 WHERE c.f >= 10
  UNION ALL
  SELECT c.lang, c.a1 || ' ' || c.a2 || ' ' || c.a3, c.f, 2, x.f, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.a1 = c.a1 AND x.a2 = c.a2 JOIN f1 y ON y.lang = c.lang AND y.p = c.a3 WHERE c.f >= 10
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, a1 || ' ' || a2 AS phrase, f FROM f3 WHERE f >= 10 UNION ALL SELECT lang, a2 || ' ' || a3, f FROM f3 WHERE f >= 10
  ) GROUP BY ALL
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN longer g USING (lang, phrase) WHERE g.f IS NULL OR 100 * g.f < 50 * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

"""Exact Jaccard join of word-shingle sets, and the groups that its links make.

Two documents link when their sets of ``words``-word shingles have a Jaccard
similarity of ``percent`` hundredths or more. The join works on an inverted index
over the prefixes of the sets and skips by two relations between sets.

*Within the index.* Shingles are ordered from rare to frequent by what a bounded sketch
has counted for them, ties by hash; any fixed order is right, and this one keeps frequent
shingles out of the lists. Similar sets share a shingle within their prefixes. A list
is split into blocks of one set size, sorted by position, and for two blocks the
positions beyond which no pair can reach the needed overlap are skipped as a whole.

*Between sets.* Equal sets are one node. Sets that are likely to be highly similar
(they agree in a band of minima) are first compared with the most central of them
alone; what a link there tells about a set, namely its group, holds for the other,
so a list only yields pairs of sets from different groups, first between one set of
each group, then, with what those tell, between all. No list is ever expanded within
a group, however large, and no pair between groups is left out.

*Within a group.* The links inside a group are counted set by set on an index of the
group's own shingles: the overlaps of a set with all others are those of the set
before it, plus the lists of the shingles that it has more, less the lists of those
that it lacks. Large groups are dealt as pairs of parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.llm.common import each, join_counted, numbered, parts_for, read_table, small, stored, text_or_empty
from lumera.llm.components import connected_components
from lumera.llm.shingles import U, mix, shingle_hashes, text_slices

#: Counters of the sketch, and the pieces in which tasks send it.
SKETCH, PIECES = 1 << 20, 64
#: Minima of a set, and how many make a band.
MINIMA, BAND = 32, 4
#: Lists longer than this are dealt as pairs of blocks of about this many sets.
LONG_LIST = 5_000
#: Lists of up to so many sets are worked through pair by pair.
SHORT_LIST = 24
#: Sets, and shingles, of a part of a group.
PART_SETS, PART_SHINGLES = 1_000, 1_000_000
#: Parts whose sets pass by an indexed part in one task.
VISITORS = 20
#: Pairs that a task remembers so as not to name them again; what it forgets is made distinct by the shuffle.
SEEN = 400_000


def _ceil(a: np.ndarray | int, b: int) -> np.ndarray | int:
    return -(-a // b)


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shared shingles that sets of sizes ``n`` and ``m`` need to link."""
    return _ceil(percent * (n + m), 100 + percent)


def prefix_length(n: int, percent: int) -> int:
    """Length of the prefix in which similar sets meet."""
    return n - int(_ceil(percent * n, 100)) + 1


def sets_of(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode() for t in texts]
    for a, b in text_slices(list(map(len, raw))):
        for h in shingle_hashes(raw[a:b], words):
            yield np.unique(h)


def digest(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def counter_of(s: np.ndarray, counters: int) -> np.ndarray:
    """Which of the ``counters`` (a power of two) count some hashes: their first bits."""
    return (s >> U(65 - counters.bit_length())).astype(np.int64)


def frequency_ranks(rows: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Rank of each counter of the sketch, which is what it has counted, and the rank from which its shingles are surely frequent.

    Counters aren't put into classes: the shingles of a frequent one rarely lie in a counter as low as those that
    fill prefixes, even where most of what any counter holds is of other shingles. With one class for all that is near the
    average, lists would grow in proportion to the corpus, and their pairs with its square.

    Occurrences are counted, repeats in a text included. Tasks count into an array of fixed size, and their arrays are added up piece by
    piece, a piece at a time. The driver receives the one sum.
    """
    width = SKETCH // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in small(batches):
            raw = [t.encode() for t in batch.column(0).to_pylist()]
            for a, b in text_slices(list(map(len, raw))):
                found = np.concatenate(list(shingle_hashes(raw[a:b], words)))
                total += np.bincount(counter_of(found, SKETCH), minlength=SKETCH)
        yield _batch({"piece": pa.int32(), "counts": pa.binary()}, np.arange(PIECES), [total[i * width : (i + 1) * width].tobytes() for i in range(PIECES)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(counts.as_py(), np.int64)
        yield _batch({"piece": pa.int32(), "counts": pa.binary()}, list(sums), [s.tobytes() for s in sums.values()])

    kind = "piece int, counts binary"
    found = rows.select("text").mapInArrow(count, kind).repartition(PIECES, "piece").mapInArrow(add, kind).collect()
    total = np.zeros(SKETCH, np.int64)
    for r in found:
        total[r.piece * width : (r.piece + 1) * width] = np.frombuffer(r.counts, np.int64)
    average = total.mean()
    usual = 3 * average + 8 * np.sqrt(average) + 16
    return np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32), int(usual) + 1


def _batch(kinds: dict[str, pa.DataType], *columns) -> pa.RecordBatch:  # noqa: ANN002
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def bands(s: np.ndarray) -> list[int]:
    """Keys of a set's bands: minima of equal parts of the range of hashes, a few to a key."""
    edge = np.searchsorted(s, np.arange(MINIMA, dtype=U) << U(64 - MINIMA.bit_length() + 1))
    padded = np.append(s, U(0))
    low = np.where(np.append(edge[1:], len(s)) > edge, padded[edge], U(1)).reshape(-1, BAND)
    keys = np.arange(len(low), dtype=U)
    for column in low.T:
        keys = mix(keys * U(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64).tolist()


def parity(s: np.ndarray) -> np.ndarray:
    """Parities of the counts of a set's hashes in slots, two slots a shingle at least.

    The slots in which two parities differ are at most as many as the shingles that
    only one of the sets has. Halves are laid over each other by exclusive or.
    """
    slots = max(1024, 1 << int(2 * len(s)).bit_length())
    counts = np.bincount((s & U(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of shingles that only one of two sets has."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def describe(rows: DataFrame, ranks: np.ndarray, frequent: int, words: int, percent: int) -> DataFrame:
    """What the join needs to know of each text: digest and size of its set, prefix, bands, centrality and parity."""
    kinds = {
        "doc_id": pa.int64(), "row_no": pa.int64(), "key": pa.string(), "digest": pa.binary(), "n": pa.int32(), "prefix": pa.list_(pa.int64()),
        "bands": pa.list_(pa.int64()), "central": pa.float32(), "parity": pa.binary(),
    }
    kind = "doc_id long, row_no long, key string, digest binary, n int, prefix array<long>, bands array<long>, central float, parity binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            out: list[tuple] = []
            for doc_id, row_no, key, s in zip(*(part.column(k).to_pylist() for k in range(3)), sets_of(part.column(3).to_pylist(), words), strict=True):
                if not len(s):
                    out.append((doc_id, row_no, key, digest(s), 0, [], [], 0.0, b""))
                    continue
                rank = ranks[counter_of(s, len(ranks))]
                order = np.argsort(rank, kind="stable")[: prefix_length(len(s), percent)]
                out.append((doc_id, row_no, key, digest(s), len(s), s[order].view(np.int64), bands(s), float((rank >= frequent).mean()), parity(s).tobytes()))
            yield _batch(kinds, *(list(c) for c in zip(*out, strict=True)))

    return rows.select("doc_id", "row_no", "key", "text").mapInArrow(run, kind)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those whose value comes more than once."""
    last: pa.RecordBatch | None = None  # the last row so far, and whether it has been given on
    given, value = False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        same = np.zeros(len(keys), bool)
        same[1:] = keys[1:] == keys[:-1]
        keep = same.copy()
        keep[:-1] |= same[1:]
        if last is not None and keys[0] == value:
            if not given:
                yield last
            keep[0] = True
        last, given, value = batch.slice(len(keys) - 1, 1), bool(keep[-1]), keys[-1]
        yield batch.filter(pa.array(keep))


def list_pairs(node: np.ndarray, group: np.ndarray, n: np.ndarray, pos: np.ndarray, side: np.ndarray, percent: int, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of different groups in one list, by blocks of set sizes.

    ``side``: 0 for all against all; in a part of a long list 1 and 2 for its two
    sides. ``one``: a single set of each group stands for it.
    """
    if one:
        order = np.lexsort((pos, group))
        first = order[np.concatenate([[True], group[order][1:] != group[order][:-1]])] if len(order) else order
        node, group, n, pos, side = node[first], group[first], n[first], pos[first], side[first]
    order = np.lexsort((pos, n))
    node, group, n, pos, side = node[order], group[order], n[order], pos[order], side[order]
    sizes, begin = np.unique(n, return_index=True)
    end = np.append(begin[1:], len(n))
    for i in range(len(sizes)):
        # Blocks of sizes up to the largest that can still be similar.
        last = np.searchsorted(sizes, 100 * sizes[i] // percent, side="right")
        for j in range(i, last):
            need = int(needed(int(sizes[i]), int(sizes[j]), percent))
            a = begin[i] + np.searchsorted(pos[begin[i] : end[i]], sizes[i] - need, side="right")
            b = begin[j] + np.searchsorted(pos[begin[j] : end[j]], sizes[j] - need, side="right")
            width = max(1, (1 << 20) // max(1, b - begin[j]))
            for at in range(begin[i], a, width):
                x = np.arange(at, min(a, at + width))[:, None]
                y = np.arange(begin[j], b)[None, :]
                fits = (group[x] != group[y]) & ((side[x] != side[y]) | (side[x] == 0))
                if i == j:
                    fits &= x < y
                p, q = np.nonzero(fits)
                if len(p):
                    yield node[p + at], node[q + begin[j]]


def candidates(lists: DataFrame, groups: DataFrame, percent: int, one: bool) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different groups that share a list and may be similar."""
    named = lists.join(groups, "node", "left").select("token", "node", F.coalesce("group", "node").alias("group"), "n", "pos")
    named = stored(named, "named")
    sizes = named.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("token", "size")
    parts = F.ceil(F.col("size") / LONG_LIST).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    # A long list's row goes to every pair of parts that its own part is in.
    other = F.sequence(F.lit(0), parts - 1)
    place = F.transform(
        other,
        lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side")),
    )
    dealt = join_counted(named, stored(sizes, "sizes"), ["token"], "size").select("token", "node", "group", "n", "pos", F.explode(place).alias("at")).select("token", F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.col("at.side").alias("side"), "node", "group", "n", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"a": pa.int64(), "b": pa.int64()}
        seen: set[tuple[int, int]] = set()

        def give(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in list_pairs(rows[4], rows[5], rows[6], rows[7], rows[3], percent, one):
                low, high = np.minimum(a, b), np.maximum(a, b)
                new = [p for p in zip(low.tolist(), high.tolist(), strict=True) if p not in seen]
                seen.update(new)
                if new:
                    yield _batch(kinds, *zip(*new, strict=True))
                if len(seen) > SEEN:
                    seen.clear()

        def short(x: int, y: int, columns: list[list]) -> list[tuple[int, int]]:
            """The pairs of a short list, one by one."""
            _, _, _, _, node, group, n, pos = columns
            found = []
            for i in range(x, y):
                for j in range(i + 1, y):
                    if group[i] != group[j]:
                        need = needed(n[i], n[j], percent)
                        if pos[i] <= n[i] - need and pos[j] <= n[j] - need:
                            pair = (node[i], node[j]) if node[i] < node[j] else (node[j], node[i])
                            if pair not in seen:
                                seen.add(pair)
                                found.append(pair)
            return found

        held: list[list[np.ndarray]] = []
        for batch in small(batches, 10_000):
            rows = [c.to_numpy() for c in batch.columns]
            edge = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
            cuts = [0, *edge.tolist(), len(rows[0])]
            columns, pairs = [c.tolist() for c in rows], []
            for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                # Short lists that neither begin nor end a batch and aren't parts of long ones.
                if 0 < k < len(cuts) - 2 and y - x <= SHORT_LIST and not rows[3][x:y].any():
                    if held:
                        yield from give([np.concatenate(c) for c in zip(*held, strict=True)])
                        held = []
                    pairs += short(x, y, columns)
                    if len(seen) > SEEN:
                        seen.clear()
                    continue
                part = [c[x:y] for c in rows]
                if held and any(held[-1][k][-1] != part[k][0] for k in range(3)):
                    yield from give([np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                held.append(part)
            if pairs:
                yield _batch(kinds, *zip(*pairs, strict=True))
        if held:
            yield from give([np.concatenate(c) for c in zip(*held, strict=True)])

    keys = ["token", "i", "j"]
    # Work goes by rows and pairs, not by bytes, so the number of tasks isn't left to the size of the shuffle.
    tasks = parts_for(lists.count(), 50_000, lists.sparkSession)
    return dealt.repartition(tasks, *map(F.col, keys)).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the parities of their sets don't rule out: (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2_000):
            keep = []
            for n, m, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                most = n + m - 2 * needed(n, m, percent)
                keep.append(least_difference(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) <= most)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name, k: nodes.select(F.col("short").alias(name), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}"))
    joined = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "n_1", "n_2", "parity_1", "parity_2")
    return joined.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, counted in full: (a, b) by digest, (short_a, short_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        kinds = {"a": pa.binary(), "b": pa.binary(), "short_a": pa.int64(), "short_b": pa.int64()}
        kept: dict[bytes, np.ndarray] = {}

        def shingles(name: bytes, z: bytes) -> np.ndarray:
            if name not in kept:
                if len(kept) > 500:
                    kept.clear()
                kept[name] = next(sets_of([unzip(z).decode()], words))
            return kept[name]

        for batch in small(batches):
            out: list = []
            for short_a, short_b, name_a, z_a, name_b, z_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = shingles(name_a, z_a), shingles(name_b, z_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if name_a != name_b and 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((name_a, name_b, short_a, short_b))
            if out:
                yield _batch(kinds, *zip(*out, strict=True))

    first = texts.select(F.col("short").alias("a"), F.col("digest").alias("digest_a"), F.col("z").alias("z_a"))
    second = texts.select(F.col("short").alias("b"), F.col("digest").alias("digest_b"), F.col("z").alias("z_b"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "digest_a", "z_a", "digest_b", "z_b")
    return joined.mapInArrow(run, "a binary, b binary, short_a long, short_b long")


class Overlaps:
    """How many shingles each of some sets shares with one more set, derived from the answer for the set before."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        self.names, token = np.unique(np.concatenate(sets), return_inverse=True)
        self.held = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)[np.argsort(token, kind="stable")]
        self.count = np.bincount(token, minlength=len(self.names))
        self.begin = np.cumsum(self.count) - self.count
        self.last, self.both = np.zeros(0, np.int64), np.zeros(len(sets), np.int64)

    def in_lists(self, of: np.ndarray) -> np.ndarray:
        """How many of the lists of some shingles each set is in."""
        long = self.count[of]
        at = np.repeat(self.begin[of] - np.cumsum(long) + long, long) + np.arange(long.sum())
        return np.bincount(self.held[at], minlength=len(self.n))

    def fits(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets are similar enough to ``s`` (sorted)."""
        at = np.minimum(np.searchsorted(self.names, s), len(self.names) - 1)
        own = at[self.names[at] == s]
        more, less = np.setdiff1d(own, self.last, assume_unique=True), np.setdiff1d(self.last, own, assume_unique=True)
        if len(more) + len(less) < len(own):
            self.both = self.both + self.in_lists(more) - self.in_lists(less)
        else:
            self.both = self.in_lists(own)
        self.last = own
        return 100 * self.both >= percent * (len(s) + self.n - self.both)


def within(groups: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int, pairs: bool) -> DataFrame:
    """The links between the sets of each group (node, group): with ``pairs`` each (a, b), the lesser first, else (node, n_links).

    A group is cut into parts. The sets of a part, indexed, meet all sets of the group,
    ``VISITORS`` parts of them in a task, which pass by one at a time. So a task sends one
    number for each set of its part, however many links there are.
    """
    named = stored(groups.join(nodes.select(F.col("short").alias("node"), "n"), "node"), "grouped")
    sizes = stored(named.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")), "group_sizes")
    parts = F.greatest(F.ceil(F.col("sets") / PART_SETS), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    block = F.floor(own / VISITORS).cast("int")
    # A set's role: 0 indexed and passing by, 1 indexed alone, 2 passing by another part.
    at = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    indexed = F.transform(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / VISITORS).cast("int")), lambda j: at(own, j, F.when(j == block, 0).otherwise(1)))
    passing = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != own), lambda i: at(i, block, F.lit(2)))
    counted = join_counted(named, sizes.select("group", "sets", parts.alias("parts")), ["group"], "sets")
    dealt = counted.select("group", "node", F.explode(F.concat(indexed, passing)).alias("at"))
    dealt = dealt.join(texts.select(F.col("short").alias("node"), "z"), "node").select("group", "at.i", "at.j", "at.role", "node", "z")
    kinds = {"a": pa.int64(), "b": pa.int64()} if pairs else {"node": pa.int64(), "n_links": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        key, held, part, node, links = None, [], None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def meet(other: int, s: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal links
            fits = part.fits(s, percent) & (node != other)
            links = links + fits
            # Each of two sets passes by the other; the greater one names the link.
            named = node[fits & (node < other)] if pairs else node[:0]
            if len(named):
                yield _batch(kinds, named, np.full(len(named), other))

        def index() -> Iterator[pa.RecordBatch]:
            """Index what is held, and let those of it pass by that are to."""
            nonlocal part, node, links, held
            part, node = Overlaps([s for _, _, s in held]), np.array([h[0] for h in held], np.int64)
            links, now, held = np.zeros(len(node), np.int64), held, []
            for other, role, s in now:
                if role == 0:
                    yield from meet(other, s)

        def give() -> Iterator[pa.RecordBatch]:
            if held:
                yield from index()
            if not pairs and links.any():
                yield _batch(kinds, node[links > 0], links[links > 0])

        for batch in small(batches):
            rows = [c.to_pylist() for c in batch.columns]
            for g, i, j, role, other, s in zip(*rows[:5], sets_of([unzip(z).decode() for z in rows[5]], words), strict=True):
                if key != (g, i, j):
                    yield from give()
                    key, held, part, links = (g, i, j), [], None, links[:0]
                if role < 2:
                    held.append((other, role, s))
                    continue
                if held:
                    yield from index()
                if part is not None:  # a part may have no sets, by chance
                    yield from meet(other, s)
        yield from give()

    keys = ["group", "i", "j"]
    found = dealt.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, "role").mapInArrow(run, "a long, b long" if pairs else "node long, n_links long")
    return found if pairs else found.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, row_col: str | None = None, whole: str = "") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents, sets, and with ``whole`` of "counts" or "pairs" the links.

    Documents: doc_id, row_no, digest, n, component_id, and the label of the group, null for
    documents without words. Sets: short, digest, n. Links by short: (node, n_links), or (a, b), each
    once, the lesser first.
    """
    row_no = (F.lit(None) if row_col is None else docs[row_col]).cast("long").alias("row_no")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), row_no, text_or_empty(docs[text_col]).alias("text")).withColumn("key", F.md5("text"))
    ranks, frequent = frequency_ranks(rows, words)
    short = F.conv(F.substr(F.hex("digest"), F.lit(1), F.lit(15)), 16, 10).cast("long")
    described = stored(describe(rows, ranks, frequent, words, percent), "described")
    members = described.select("doc_id", "row_no", "digest", "n")
    nodes = stored(
        described.where("n > 0")
        .groupBy("digest")
        .agg(*[F.first(c).alias(c) for c in ("n", "prefix", "bands", "central", "parity")], F.min("key").alias("key"))
        .withColumn("short", short),
        "nodes",
    )

    # Lists of more than one set.
    postings = nodes.select(F.posexplode("prefix").alias("pos", "token"), F.col("short").alias("node"), "n").select("token", "node", "n", "pos")
    lists = stored(postings.repartition(F.col("token")).sortWithinPartitions("token").mapInArrow(_repeated, "token long, node long, n int, pos int"), "lists")

    # Stars: each set of a band with the most central set of the band.
    banded = nodes.select(F.explode("bands").alias("band"), "short", "central", "n")
    centres = banded.groupBy("band").agg(F.max(F.struct("central", "short")).alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", F.col("centre.short").alias("centre"))
    stars = stored(
        banded.join(centres, "band").where("short <> centre").select(F.least("short", "centre").alias("a"), F.greatest("short", "centre").alias("b")).distinct(),
        "stars",
    )

    # The texts of all sets that any pair can name.
    wanted = lists.select(F.col("node").alias("short")).unionByName(stars.select(F.col("a").alias("short"))).unionByName(stars.select(F.col("b").alias("short"))).distinct()
    named = nodes.select("digest", "short", "key").join(wanted, "short")

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part in small(batches):
            yield _batch({"key": pa.string(), "z": pa.binary()}, part.column(0).to_pylist(), [squeeze(t.encode()) for t in part.column(1).to_pylist()])

    packed = rows.select("key", "text").mapInArrow(zipped, "key string, z binary")
    texts = stored(packed.join(named, "key").groupBy("digest", "short").agg(F.first("z").alias("z")), "texts")

    links = stored(verified(possible(stars, nodes, percent), texts, words, percent), "links")
    tried = None
    for one in (True, False):
        short_links = links.select(F.col("short_a").alias("a"), F.col("short_b").alias("b"))
        groups = connected_components(short_links).select("node", F.col("label").alias("group"))
        pairs = candidates(lists, groups, percent, one)
        # What has been compared before isn't compared again.
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        tried = stored(pairs, "pairs")
        new = stored(verified(possible(tried, nodes, percent), texts, words, percent), "links")
        links = links.unionByName(new)

    labels = connected_components(links.select(F.hex("a").alias("a"), F.hex("b").alias("b"))).select(F.unhex("node").alias("digest"), "label")
    least = members.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    owned = least.join(labels, "digest", "left").select("digest", "least", F.coalesce("label", F.hex("digest")).alias("label"))
    roots = owned.join(owned.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("digest", "label", "component_id")
    found = members.join(roots, "digest", "left").select("doc_id", "row_no", "digest", "n", F.coalesce("component_id", "doc_id").alias("component_id"), "label")
    if not whole:
        return found, nodes, None
    # What the last round found lies between its groups, and all that was found before lies within them.
    between = new.select(F.least("short_a", "short_b").alias("a"), F.greatest("short_a", "short_b").alias("b"))
    inside = within(groups, nodes, texts, words, percent, whole == "pairs")
    if whole == "pairs":
        return found, nodes, between.unionByName(inside)
    ends = between.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    return found, nodes, ends.unionByName(inside).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents that links of the exact Jaccard join connect.

    Words are runs of characters other than white space, A-Z lower-cased. A text
    with fewer than ``words`` words has its whole sequence as its one shingle; null,
    empty and blank texts have none and link with nothing. Equal sets always link,
    so repeated rows share a group. Other columns are ignored. An empty table gives
    no rows.

    Returns doc_id, n_shingles, component_id (the least id of the group; null ids
    come last), n_links (the other distinct sets that the document's set links with).
    """
    found, nodes, links = _joined(docs, id_col, text_col, words, percent, whole="counts")
    counted = nodes.select("digest", F.col("short").alias("node")).join(links, "node").select("digest", "n_links")
    return found.join(counted, "digest", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """All links of the exact Jaccard join, each pair of distinct sets once.

    Texts and nulls are treated as in :func:`jaccard_groups`. A set is named by its
    digest in hex and by the least id of its documents.

    Returns set_a, set_b, doc_a, doc_b.
    """
    found, nodes, links = _joined(docs, id_col, text_col, words, percent, whole="pairs")
    least = found.groupBy("digest").agg(F.min("doc_id").alias("doc"))
    named = nodes.select("short", "digest").join(least, "digest")
    side = lambda k: named.select(F.col("short").alias(k), F.hex("digest").alias(f"set_{k}"), F.col("doc").alias(f"doc_{k}"))
    return links.join(side("a"), "a").join(side("b"), "b").select("set_a", "set_b", "doc_a", "doc_b")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of :func:`jaccard_groups`, with all its columns.

    The row of least id stays (null ids come last), of several such rows the first.
    Documents without words stay. An empty table gives no rows.
    """
    rows, row = numbered(docs)
    found = stored(_joined(rows, id_col, text_col, words, percent, row)[0].where("label IS NOT NULL").select("doc_id", "row_no", "label"), "labelled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("first")
    best = found.groupBy("label").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1").select("label", F.col("first.row_no").alias("best"))
    gone = found.join(best, "label").where("row_no <> best").select(F.col("row_no").alias(row))
    return rows.join(gone, row, "left_anti").select(*each(rows, docs.columns))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all documents whose sets of four-word shingles are similar by 85 % or more."""
    return jaccard_groups(read_table(spark, sf_dir, "documents"), words=4, percent=85)

"""Packing of documents into training sequences by swap-based local search.

Documents are tokenised where they are read; only their lengths move on. Pieces
are dealt into shards of bounded size. In each shard pieces first go into sequences
as they come (next fit); a local search then exchanges pieces between underfull
sequences, one for one, two for one or as moves, each exchange raising the sum of
squared fills, until sequences empty. It works in rounds of numpy over all
sequences of the shard at once. Best fit packs again what is left in underfull
sequences, and more of the shard as long as that saves sequences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.llm import tokens
from lumera.llm.common import read_table, small, text_or_empty

#: Documents of one shard, about.
SHARD = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: only longer ones are cut, the first piece taking the odd length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        deal = TaskContext.get().partitionId() << 40
        for batch in small(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                rows: list[tuple] = []
                for doc_id, found in zip(ids[a:b], tokens.encoder(tokenizer).encode(texts[a:b]), strict=True):
                    raw = found + end
                    n = len(raw) // 4
                    start, stop = 0, (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), deal))
                        start, stop, deal = stop, stop + capacity, deal + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences of piece numbers by best fit, longest pieces first.

    ``open_`` holds sequences by room left; a bit mask of the rooms in use finds
    the smallest that is large enough.
    """
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        if room > n:
            open_[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def next_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence number of each piece: pieces in their order, a new sequence whenever one doesn't fit."""
    ends = np.cumsum(lengths)
    out, start, before, b = np.zeros(len(lengths), np.int64), 0, 0, 0
    while start < len(lengths):
        stop = int(np.searchsorted(ends, before + capacity, side="right"))
        out[start:stop] = b
        start, before, b = stop, int(ends[stop - 1]), b + 1
    return out


def _pairs(bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of pieces of one sequence that differ in their lengths: (i, j).

    Pieces of one length are interchangeable, so the first two of each length stand
    for all; what fits a sequence has few different lengths.
    """
    order = np.lexsort((lengths, bins))
    new = np.ones(len(order), bool)
    new[1:] = (bins[order][1:] != bins[order][:-1]) | (lengths[order][1:] != lengths[order][:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    order = order[nth < 2]
    edge = np.flatnonzero(np.append(True, bins[order][1:] != bins[order][:-1])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(order)))
    behind = np.repeat(edge + size, size) - np.arange(len(order)) - 1
    i = np.repeat(np.arange(len(order)), behind)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
    return order[i], order[j]


class _Options:
    """What some sequences can give: nothing, a piece, or two pieces together."""

    def __init__(self, bins: np.ndarray, amount: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        self.bins, self.amount, self.first, self.second = bins, amount, first, second

    @staticmethod
    def of(pieces: np.ndarray, bins: np.ndarray, lengths: np.ndarray, two: bool) -> _Options:
        if not two:
            return _Options(bins[pieces], lengths[pieces], pieces, np.full(len(pieces), -1))
        i, j = _pairs(bins[pieces], lengths[pieces])
        i, j = pieces[i], pieces[j]
        return _Options(bins[i], lengths[i] + lengths[j], i, j)

    def with_nothing(self, bins: np.ndarray) -> _Options:
        none = np.full(len(bins), -1)
        return _Options(*(np.concatenate(x) for x in ((bins, self.bins), (np.zeros(len(bins), np.int64), self.amount), (none, self.first), (none, self.second))))


def _first_of(values: np.ndarray) -> np.ndarray:
    """Whether each value comes for the first time."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def matched(give: _Options, take: _Options, fill: np.ndarray, capacity: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Exchanges (option of a donor, option of a taker) that leave a taker at most ``slack`` of room and fuller than it was.

    A taker that hands out ``y`` has room for ``room + y``. Takers are ordered by that,
    and every donor's option goes to the least that holds it, equal options to one
    after the other. Of what clashes the tightest is kept, so that each sequence
    takes part in one exchange.
    """
    holds = capacity - fill[take.bins] + take.amount
    by_hold, by_amount = np.argsort(holds, kind="stable"), np.argsort(give.amount, kind="stable")
    holds, amount = holds[by_hold], give.amount[by_amount]
    new = np.flatnonzero(np.append(True, amount[1:] != amount[:-1])) if len(amount) else np.zeros(0, np.int64)
    nth = np.arange(len(amount)) - np.repeat(new, np.diff(np.append(new, len(amount))))
    place = np.searchsorted(holds, amount) + nth
    ok = place < len(holds)
    x, y = by_amount[ok], by_hold[place[ok]]
    left = holds[place[ok]] - amount[ok]
    gain = give.amount[x] - take.amount[y]
    ok = (left <= slack) & (gain > np.maximum(0, fill[give.bins[x]] - fill[take.bins[y]]))
    order = np.lexsort((-give.amount[x[ok]], left[ok]))
    x, y = x[ok][order], y[ok][order]
    once = _first_of(give.bins[x])
    x, y = x[once], y[once]
    once = _first_of(take.bins[y])
    return x[once], y[once]


def local_search(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence number of each piece after the search, from the sequence numbers ``bins``.

    Donors give, other underfull sequences take. In a round every sequence takes part in
    at most one exchange: a piece moves, goes for a shorter one, for two that are
    shorter together, or two go for one. Every exchange adds more to the taker than
    the donor was ahead of it, so squared fill rises with each. First the donors are
    the sequences of the shortest pieces, as many as there are beyond the least possible
    number, and their longest pieces go first; then the emptiest sequences; then every
    other one in the order of fill. Exchanges that fill a sequence exactly come
    before ones that leave room. The search ends at the least possible number of
    sequences or when a pass finds no exchange.
    """
    bins, lengths = np.unique(bins, return_inverse=True)[1], np.asarray(lengths, np.int64)
    n = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, lengths, n).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    levels = [0, *(1 << k for k in range(1, capacity.bit_length() - 1, 2))]
    floors = sorted({max(1, round(capacity * 0.6**k)) for k in range(1, 16)}, reverse=True)
    steps = [step for floor in floors for step in [*((floor, slack, "largest", 1, 1) for slack in levels), (floor, capacity, "largest", 1, 0)]]
    again = len(steps)
    for rank in ("fill", "every other"):
        steps += [(1, slack, rank, give, take) for slack in levels for give, take in ((1, 1), (2, 1), (1, 2))] + [(1, capacity, rank, 1, 0)]
    rising = np.argsort(lengths, kind="stable")
    at, any_ = 0, False
    while at < len(steps) or any_:
        if at == len(steps):  # once more, as long as there was an exchange
            at, any_ = again, False
        used = int((fill > 0).sum())
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        if used <= least or len(under) < 2:
            break
        floor, slack, rank, give, take = steps[at]
        by = fill
        if rank == "largest":
            by = np.zeros(n, np.int64)
            by[bins[rising]] = lengths[rising]  # of several pieces the longest is written last
        under = under[np.argsort(by[under], kind="stable")]
        donors = max(1, min(used - least, len(under) - 1))
        givers, takers = (under[::2], under[1::2]) if rank == "every other" else (under[:donors], under[donors:])
        takers = takers[(capacity - fill[takers] > slack) | (slack == capacity)]
        is_donor, is_taker = np.zeros(n, bool), np.zeros(n, bool)
        is_donor[givers], is_taker[takers] = True, True
        pieces = np.flatnonzero(is_donor[bins] | is_taker[bins])
        gives = _Options.of(pieces[is_donor[bins[pieces]] & (lengths[pieces] >= floor)], bins, lengths, give == 2)
        takes = _Options.of(pieces[is_taker[bins[pieces]] & (take > 0)], bins, lengths, take == 2).with_nothing(takers)
        x, y = matched(gives, takes, fill, capacity, slack)
        if not len(x):
            at += 1
            continue
        any_ = True
        donor, taker, gain = gives.bins[x], takes.bins[y], gives.amount[x] - takes.amount[y]
        for moved, to in ((gives.first[x], taker), (gives.second[x], taker), (takes.first[y], donor), (takes.second[y], donor)):
            bins[moved[moved >= 0]] = to[moved >= 0]
        fill[donor] -= gain
        fill[taker] += gain
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence number of each piece: next fit, the local search, and best fit for what it leaves in underfull sequences.

    Best fit takes the underfull sequences apart and, while there are more sequences
    than need be, with them those of the most pieces, twice as many each time. At the
    last that is all, so the result is never above best fit.
    """
    lengths = np.asarray(lengths, np.int64)
    bins = local_search(next_fit(lengths, capacity), lengths, capacity)
    least, more = -(-int(lengths.sum()) // capacity), 0
    while len(bins):
        bins = np.unique(bins, return_inverse=True)[1]
        fill, pieces = np.bincount(bins, lengths), np.bincount(bins)
        if len(fill) <= least:
            break
        under = fill < capacity
        full = np.flatnonzero(~under)
        apart = under.copy()
        apart[full[np.argsort(-pieces[full], kind="stable")[:more]]] = True
        rest = np.flatnonzero(apart[bins])
        again = best_fit(lengths[rest].tolist(), capacity)
        if len(again) < apart.sum():
            for s, members in enumerate(again, len(fill)):
                bins[rest[members]] = s
        if apart.all():
            break
        more = max(2 * more, int(under.sum()))
    return np.unique(bins, return_inverse=True)[1]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    shard: int = SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents, each followed by ``end_id``, into sequences of at most ``capacity`` tokens.

    A null text counts as empty and is packed as its end id; a null id is kept.
    Repeated rows are packed as often as they come. Other columns are ignored. An
    empty table gives no rows. Pieces are dealt to shards by their place in the
    input, so neither long documents nor repeated ids crowd one.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    shards = max(1, math.ceil(docs.count() / shard))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("deal", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        whole, part = np.flatnonzero(lengths == capacity), np.flatnonzero(lengths < capacity)
        sequence[whole] = np.arange(len(whole))
        sequence[part] = len(whole) + pack_lengths(lengths[part], capacity)
        order = np.argsort(sequence, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        new = np.flatnonzero(np.append(True, sequence[order][1:] != sequence[order][:-1]))
        offset[order] = before - np.repeat(before[new], np.diff(np.append(new, len(order))))
        return pdf.drop(columns=["deal", "shard"]).assign(sequence_id=(int(key[0]) << 40) + sequence, offset=offset)

    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    return pieces.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards))).groupBy("shard").applyInPandas(pack, PACKED)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), tokens.default_tokenizer())

"""Toxicity severity by cumulative-link ordinal regression.

Severity grades g_0 < g_1 < ... are modelled by ``P(grade > g_k) = sigmoid(w.x - t_k)``:
one weight vector ``w`` over sparse text features is shared by all ordered
thresholds ``t_0 < t_1 < ...``. A document's expected severity is the least grade
plus the sum of these probabilities, each times the step to the next grade. The model is fitted on a bounded sample of labelled rows by proximal
gradient steps with an L1 penalty, which leaves weights only on words that tell
grades apart.

Features are hashed words and the first letters of longer words, so that families of
words are heard; the value of each is the logarithm of its rate in the text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumera.llm.common import read_table, small, stored, text_or_empty

#: Places of hashed words; a word has a weight if at least ``LEAST_ROWS`` sample rows have it.
FEATURES, LEAST_ROWS = 1 << 26, 3
#: Labelled rows that the fit uses at most, of each grade and in all; every grade has an equal part of the latter.
SAMPLE, SAMPLE_ALL = 3_000, 60_000
#: A document is rejected when its expected severity, as a share of the top grade, is above this.
REJECT = 0.6
WORD = re.compile(r"[^\W\d_]+")
#: Words that a task remembers.
REMEMBERED = 100_000


def place(word: str) -> int:
    """The place that a word is hashed to."""
    return zlib.crc32(word.encode()) % FEATURES


def parts(word: str) -> tuple[int, ...]:
    """Places of a word and of its beginning, which word families share."""
    return (place(word), place(f"{word[:4]}-")) if len(word) > 4 else (place(word),)


def value(count: np.ndarray | float, words: int) -> np.ndarray | float:
    """The value of a feature that comes ``count`` times in a text of ``words`` words."""
    return np.log1p(300.0 * count / max(words, 20))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the features of a whole text."""
    found: Counter[int] = Counter()
    words = WORD.findall(text.lower())
    for word, n in Counter(words).items():
        for at in parts(word):
            found[at] += n
    return np.fromiter(found, np.int64, len(found)), value(np.fromiter(found.values(), np.float64, len(found)), len(words))


@dataclass
class OrdinalModel:
    """Shared weights by place, those that aren't zero, ordered thresholds, and the grades between which they lie."""

    weights: dict[int, float]
    thresholds: np.ndarray
    levels: np.ndarray

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Expected severity of linear scores."""
        above = 1.0 / (1.0 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))
        return self.levels[0] + above @ np.diff(self.levels).astype(np.float64)

    def nearest(self, severity: np.ndarray) -> np.ndarray:
        """The grade nearest to each severity; of two the lower."""
        return self.levels[np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, severity)]

    def rejected(self, severity: np.ndarray, reject: float) -> np.ndarray:
        """Whether each severity lies above the share ``reject`` of the way from the least grade to the greatest."""
        return severity > self.levels[0] + reject * (self.levels[-1] - self.levels[0])

    def score(self, text: str, memo: dict[str, tuple[int, ...]]) -> float:
        """Linear score of a text; ``memo`` keeps which places of words have weights between calls."""
        found: dict[int, int] = {}
        words = WORD.findall(text.lower())
        for word, n in Counter(words).items():
            places = memo.get(word)
            if places is None:
                places = tuple(at for at in parts(word) if at in self.weights)
                if len(memo) < REMEMBERED:
                    memo[word] = places
            for at in places:
                found[at] = found.get(at, 0) + n
        return float(sum(self.weights[at] * value(n, len(words)) for at, n in found.items()))

    def severity(self, texts: list[str], memo: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Expected severity of texts."""
        return self.expected(np.array([self.score(t, memo) for t in texts], dtype=np.float64))


#: Words taken up at a time by the fit, how closely its optimality is met (of the penalty), and rows of a dense block.
WORKING, CLOSE, BLOCK_ROWS = 300, 1e-3, 4_096


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, penalty: float = 5e-4) -> OrdinalModel:
    """The minimum of the mean cumulative-link loss plus ``penalty`` times the weights' sizes.

    There is a threshold between each two grades that come next to each other. Its
    two sides weigh the same in the loss, so rare grades are heard. With less than two
    grades there is one threshold, at 0, and no word has a weight.

    Proximal Newton steps on a working set: words with a weight, and those whose slope
    most exceeds the penalty. The fit ends when no word's slope leaves what the penalty
    allows by more than CLOSE of it and the thresholds' slopes are as small, or when
    doubles can't make the loss any smaller; there is no limit to the steps.
    """
    levels, grades = np.unique(grades, return_inverse=True)
    if len(levels) < 2:
        least = int(levels[0]) if len(levels) else 0
        return OrdinalModel({}, np.zeros(1), np.array([least, least + 1]))
    top = len(levels) - 1
    index = np.concatenate([p for p, _ in rows])
    places, column, held = np.unique(index, return_inverse=True, return_counts=True)
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    common = held >= LEAST_ROWS
    keep, number = common[column], np.cumsum(common) - 1
    places, column, value, row = places[common], number[column[keep]], value[keep], row[keep]
    above = grades[:, None] > np.arange(top)[None, :]
    share = np.clip(above.mean(axis=0), 1e-6, 1 - 1e-6)
    loss_weight = np.where(above, 0.5 / share, 0.5 / (1 - share)) / len(rows)
    w, t = np.zeros(len(places)), np.zeros(top)

    def state(score: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray]:
        """The objective, and the probability of lying above each threshold."""
        margin = score[:, None] - t[None, :]
        loss = np.logaddexp(0.0, np.where(above, -margin, margin))
        return float((loss_weight * loss).sum()) + penalty * float(np.abs(w).sum()), 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))

    score = np.zeros(len(rows))
    best, p = state(score, w, t)
    while True:
        slope = loss_weight * (p - above)
        to_w, to_t = np.bincount(column, value * slope.sum(axis=1)[row], minlength=len(places)), -slope.sum(axis=0)
        off = np.where(w != 0, np.abs(to_w + penalty * np.sign(w)), np.maximum(np.abs(to_w) - penalty, 0.0))
        if max(off.max(initial=0.0), np.abs(to_t).max()) <= CLOSE * penalty:
            break
        fresh = np.flatnonzero((w == 0) & (off > 0))
        fresh = fresh[np.argsort(-off[fresh], kind="stable")[:WORKING]]
        work = np.union1d(np.flatnonzero(w), fresh)
        step_w, step_t = _newton_step(work, w, (to_w, to_t), loss_weight * p * (1 - p), (row, column, value), penalty)
        moved = np.bincount(row, value * _spread(work, step_w, len(places))[column], minlength=len(rows))
        # Armijo's rule on the objective: the step is halved until it is worth it.
        gain = float(to_w[work] @ step_w + to_t @ step_t) + penalty * float(np.abs(w[work] + step_w).sum() - np.abs(w[work]).sum())
        size, done = 1.0, False
        while size > 1e-12:
            new_w, new_t = w.copy(), np.maximum.accumulate(t + size * step_t)
            new_w[work] += size * step_w
            found, new_p = state(score + size * moved, new_w, new_t)
            if found <= best + 1e-4 * size * gain and found < best:
                done = True
                break
            size /= 2
        if not done:
            break
        w, t, best, p, score = new_w, new_t, found, new_p, score + size * moved
    return OrdinalModel({int(at): float(x) for at, x in zip(places, w, strict=True) if x}, t, levels)


def _spread(work: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    out[work] = values
    return out


def _newton_step(work: np.ndarray, w: np.ndarray, slopes: tuple[np.ndarray, np.ndarray], curve: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The step that makes the second-order model of the loss plus the penalty least, by coordinate descent.

    ``curve``: second derivatives by row and threshold. The matrix of the working set is
    summed up from dense blocks of rows.
    """
    row, column, value = entries
    number = np.full(len(w), -1)
    number[work] = np.arange(len(work))
    inside = number[column] >= 0
    row, column, value = row[inside], number[column[inside]], value[inside]
    n, top = len(work), curve.shape[1]
    h = np.zeros((n + top, n + top))
    for a in range(0, len(curve), BLOCK_ROWS):
        lo, hi = np.searchsorted(row, (a, a + BLOCK_ROWS))
        block = np.zeros((min(BLOCK_ROWS, len(curve) - a), n))
        block[row[lo:hi] - a, column[lo:hi]] = value[lo:hi]
        c = curve[a : a + BLOCK_ROWS]
        h[:n, :n] += block.T @ (block * c.sum(axis=1, keepdims=True))
        h[:n, n:] -= block.T @ c
    h[n:, :n] = h[:n, n:].T
    h[n:, n:] = np.diag(curve.sum(axis=0))
    diagonal = np.diag(h) + 1e-10
    g = np.concatenate([slopes[0][work], slopes[1]])
    d, now = np.zeros(n + top), np.concatenate([w[work], np.zeros(top)])
    # Coordinates in turn until none moves by more than a thousandth of the first round's greatest move.
    limit, first = penalty * np.concatenate([np.ones(n), np.zeros(top)]), None
    while True:
        most = 0.0
        for j in range(n + top):
            at = now[j] + d[j]
            target = at - g[j] / diagonal[j]
            target = np.sign(target) * max(abs(target) - limit[j] / diagonal[j], 0.0) if limit[j] else target
            move = target - at
            if move:
                d[j] += move
                g += move * h[:, j]
                most = max(most, abs(move) * diagonal[j])
        first = most if first is None else first
        if most <= 1e-3 * first or most <= 1e-2 * CLOSE * penalty:
            return d[:n], d[n:]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on a bounded sample of the labelled rows: ``sample`` of each grade, those of least id hash.

    ``labels`` has ``id_col`` and a whole-number ``grade_col``; rows with a null in
    either, or without a document, are left out, as are grades below 0. A label that
    is repeated counts once, at its highest grade; of documents that repeat an id, the least
    text is taken. All grades are taken; where there
    are so many that ``SAMPLE_ALL`` rows wouldn't do, each has an equal part of these,
    one row at least. Executors turn texts into features; the driver gets these
    alone. Without two usable grades the model knows no words and puts every document
    at the middle of the scale. Null texts count as empty.
    """
    marks = labels.select(labels[id_col].alias("_id"), labels[grade_col].cast("int").alias("grade")).where("_id IS NOT NULL AND grade >= 0")
    marks = stored(marks.groupBy("_id").agg(F.max("grade").alias("grade")), "labels")
    sizes = stored(marks.groupBy("grade").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    each = max(1, min(sample, SAMPLE_ALL // max(1, sizes.count())))
    # A hash threshold first leaves somewhat more than is wanted of each grade, so that no task orders a frequent one.
    share = (1.5 * each + 100) / F.col("rows")
    near = marks.join(sizes, "grade").where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < share * (1 << 40))
    order = Window.partitionBy("grade").orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)), "_id")
    few = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("_id", "grade")
    texts = docs.select(docs[id_col].alias("_doc"), text_or_empty(docs[text_col]).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.astype("<i4").tobytes() for p, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())],
                names=["grade", "places", "vals"],
            )

    # The labelled ids are few by the bound above, so they go to where the texts are.
    # Of rows that repeat an id, one is taken, so that the sample bounds what the driver gets.
    chosen = texts.join(F.broadcast(few), F.col("_doc") == F.col("_id")).groupBy("_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
    rows = chosen.mapInArrow(make, "grade int, places binary, vals binary").collect()
    rows = sorted(rows, key=lambda r: (r.grade, bytes(r.places), bytes(r.vals)))
    pairs = [(np.frombuffer(r.places, "<i4").astype(np.int64), np.frombuffer(r.vals, "<f4").astype(np.float64)) for r in rows]
    return fit_ordinal(pairs, np.array([r.grade for r in rows], dtype=np.int64))


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """Expected severity and verdict of every whole text.

    Null and empty texts have no words and are never rejected. Repeated rows are
    scored alike. Other columns are ignored. An empty table gives no rows. The
    weights that aren't zero travel with the tasks; the fit's sample bounds them.

    Returns doc_id, severity (least to greatest grade), grade (the nearest), toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            severity = model.severity(texts, memo)
            toxic = model.rejected(severity, reject) & np.array([bool(t) for t in texts], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(model.nearest(severity).astype(np.int32)), pa.array(toxic)], names=["doc_id", "severity", "grade", "toxic"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The documents that aren't rejected, with all their columns.

    Null and empty texts stay, and so do null ids. Repeated rows are judged alike, and
    a severity that lies on the limit isn't rejected. An empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in small(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            kept = [not t or not bad for t, bad in zip(texts, model.rejected(model.severity(texts, memo), reject), strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    # Names with dots can't be given to mapInArrow, so columns go through it by number.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def graded_labels(labels: DataFrame) -> DataFrame:
    """The labels table as ordinal grades: 0 clean, 1 toxic; null labels are left out."""
    return labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, fitted on the labelled ones."""
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, graded_labels(read_table(spark, sf_dir, "labels"))))

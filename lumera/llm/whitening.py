"""Whitening of vectors by principal components of an exact integer scatter.

Entries become whole numbers, a shift is subtracted, and sums and cross-products are
accumulated without any rounding: a batch is cut into digits of 20 bits, digit
matrices are multiplied by BLAS (every partial sum stays below 2^53, so a double holds
it), and the products are carried in digits of 20 bits as far up as they reach. Tasks
send digits, which Spark adds up. n·XᵀX - SSᵀ is then formed in whole numbers of any
size and only afterwards turned into doubles for eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.llm.common import read_table, stored

#: An entry c becomes floor(SCALE * c) + SHIFT; the scatter doesn't depend on the shift.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Bits of a digit, and rows multiplied at once: 2 * (DIGIT - 1) + log2(ROWS) bits fit in a double.
DIGIT, ROWS = 20, 8192
HALF, MASK = 1 << (DIGIT - 1), (1 << DIGIT) - 1
#: Batches between two carries.
CARRY = 128
#: A component counts if its eigenvalue is above this share of the greatest for each dimension.
LEAST = 4 * np.finfo(float).eps
#: What fits in a decimal of 38 digits.
WIDEST = 10**38


@dataclass(frozen=True)
class Whitening:
    """What is learned from ``n`` vectors of one length."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    """Unit eigenvectors as columns, by falling eigenvalue."""
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        """Share of the variance of each component; 0 where there is no variance."""
        return self.eigenvalues / self.trace if self.trace > 0 else np.zeros(len(self.eigenvalues))

    @property
    def sound(self) -> np.ndarray:
        """Which components have a variance to divide by."""
        return self.eigenvalues > max(0.0, self.eigenvalues[:1].sum()) * LEAST * len(self.sums)


def finite_vectors(df: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is neither null nor holds nulls, infinities or what is not a number."""
    v = df[vector_col].cast("array<double>")
    return df.where(v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))))


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c): 64-bit numbers, or Python's where those don't reach."""
    scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(c) for c in row] for row in scaled], dtype=object)


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Digits in -HALF..HALF-1, least first, as doubles."""
    found = []
    while True:
        low = ((y + HALF) & MASK) - HALF
        found.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
        if not y.any():
            return found


def carried(sums: list[np.ndarray]) -> list[np.ndarray]:
    """The same numbers with each digit in -HALF..HALF-1."""
    out, carry = [], np.int64(0)
    sums = list(sums)
    while sums or np.any(carry):
        total = (sums.pop(0) if sums else np.zeros_like(carry)) + carry
        low = ((total + HALF) & MASK) - HALF
        out.append(low)
        carry = (total - low) >> DIGIT
    return out


class Scatter:
    """Sums and cross-products of the vectors of one length, in digits; row ``dim`` holds sums and their number."""

    def __init__(self, dim: int) -> None:
        self.dim, self.sums, self.batches = dim, [], 0

    def add(self, y: np.ndarray) -> None:
        for a in range(0, len(y), ROWS):
            ones = np.ones((len(y[a : a + ROWS]), 1))
            parts = [np.hstack([d, ones if k == 0 else 0 * ones]) for k, d in enumerate(digits(y[a : a + ROWS]))]
            for i, p in enumerate(parts):
                for j, q in enumerate(parts):
                    while len(self.sums) <= i + j:
                        self.sums.append(np.zeros((self.dim + 1, self.dim + 1), np.int64))
                    self.sums[i + j] += (p.T @ q).astype(np.int64)
            self.batches += 1
            if self.batches % CARRY == 0:
                self.sums = carried(self.sums)

    def rows(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Dimension, matrix row, digit and the entries from the diagonal on."""
        for k, m in enumerate(carried(self.sums)):
            for i in range(self.dim + 1):
                yield self.dim, i, k, m[i, i:]


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and values of the vectors of each length of an Arrow list column."""
    offsets = np.asarray(column.offsets)
    sizes, flat = np.diff(offsets), np.asarray(column.flatten())
    offsets = offsets - offsets[0]
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, flat[(offsets[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> dict[int, Whitening]:
    """Exact covariance and its components, for each length of vector that occurs.

    Rows whose vector is null or holds nulls or non-finite entries are left out, empty
    vectors too; repeated rows count as often as they come. Vectors of different
    lengths are fits of their own. Without vectors there is no fit. Entries may be of
    any size. Other columns are ignored, whatever their names.

    Tasks send a matrix in digits, which Spark sums entry by entry; the driver gets
    the one matrix of each length, as eigh needs it, and no vectors.
    """
    kind = "dim int, row int, digit int, entries array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Scatter] = {}
        for batch in batches:
            for dim, _, values in _by_length(batch.column(0)):
                if dim:
                    held.setdefault(dim, Scatter(dim)).add(whole_numbers(values, scale))
        for s in held.values():
            rows = list(s.rows())
            arrays = [pa.array([r[i] for r in rows], pa.int32()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["dim", "row", "digit", "entries"])

    kept = finite_vectors(vectors, vector_col)
    sent = kept.select(kept[vector_col].cast("array<double>").alias("v")).mapInArrow(run, kind)
    cells = sent.select("dim", "row", "digit", F.posexplode("entries").alias("col", "v"))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in cells.groupBy("dim", "row", "col", "digit").agg(F.sum("v").alias("v")).where("v <> 0").collect():
        at = found.setdefault(r.dim, {})
        key = (r.row, r.row + r.col)
        at[key] = at.get(key, 0) + (r.v << (DIGIT * r.digit))
    return {dim: _solved(dim, cells, shift) for dim, cells in sorted(found.items())}


def _solved(dim: int, cells: dict[tuple[int, int], int], shift: int) -> Whitening:
    n = cells[dim, dim]
    sums = [cells.get((i, dim), 0) for i in range(dim)]
    covariance, trace = np.empty((dim, dim)), 0
    for i in range(dim):
        for j in range(i, dim):
            exact = n * cells.get((i, j), 0) - sums[i] * sums[j]
            covariance[i, j] = covariance[j, i] = exact / (n * n)  # division of whole numbers, rounded once
            trace += exact if i == j else 0
    values, columns = np.linalg.eigh(covariance)
    falling = np.argsort(-values, kind="stable")
    return Whitening(n, tuple(s + n * shift for s in sums), columns[:, falling], values[falling], trace / (n * n))


def _deviations(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - S, exactly."""
    most = max(int(abs(y).max(initial=0)) * n, max(map(abs, sums.tolist()), default=0))
    return n * (y if most < 1 << 61 else y.astype(object)) - (sums.astype(np.int64) if most < 1 << 61 else sums)


def whiten(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Coordinates of each vector on the first components, each divided by its deviation.

    Rows that :func:`fit_whitening` leaves out are left out; so are vectors of a length
    without a fit. Ids may be null or repeat: a row stays a row. A component without
    variance has null coordinates. ``deviation``, the squared distance from the mean
    times n², is exact; it is null beyond 38 digits. An empty table gives no rows.
    Other columns are ignored.

    Returns id_col, dim, n, deviation decimal(38,0), whitened array<double>.
    """
    kept = finite_vectors(vectors, vector_col)
    kept = kept.select(kept[id_col].alias(id_col), kept[vector_col].cast("array<double>").alias("_v"))
    id_type = kept.schema[0].dataType
    names = [id_col, "dim", "n", "deviation", "whitened"]
    maps = {dim: np.where(m.sound, m.components / np.sqrt(np.where(m.sound, m.eigenvalues, 1)), np.nan)[:, :components] for dim, m in models.items()}
    facts = {dim: (m.n, np.array([s - m.n * shift for s in m.sums], dtype=object)) for dim, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, values in _by_length(batch.column(1)):
                if dim not in maps:
                    continue
                n, sums = facts[dim]
                off = _deviations(whole_numbers(values, scale), n, sums)
                # Squares may pass 64 bits: Python's numbers where they could.
                wide = off if off.dtype != object and np.abs(off).max() < 1 << 31 and dim < 1 << 31 and int(np.abs(off).max()) ** 2 * dim < 1 << 62 else off.astype(object)
                squares = [int(s) for s in (wide * wide).sum(axis=1)]
                centred = np.array([[c / n for c in row] for row in off], float) if off.dtype == object else off / n
                out = centred @ maps[dim]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel(), from_pandas=True))
                wide_enough = [s if s < WIDEST else None for s in squares]
                arrays = [batch.column(0).take(pa.array(at)), pa.array([dim] * len(at), pa.int32()), pa.array([n] * len(at), pa.int64()), pa.array(wide_enough, pa.decimal128(38, 0)), lists]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return kept.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, dim int, n long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, models: dict[int, Whitening], components: int = COMPONENTS) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity; 0 without vectors.

    ``whitened`` is stored, as it is read twice: for the means, and for the products of
    what is left without them. Components without variance are left out.
    """
    sound = {dim: m.sound[:components] for dim, m in models.items()}

    def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.column(1).filter(pa.array(dims == dim))
            width = len(sound[dim])
            yield dim, np.asarray(part.flatten()).reshape(-1, width)[:, sound[dim]]

    def summed(f) -> dict[tuple[int, int], np.ndarray]:  # noqa: ANN001
        """Sums of the rows of ``f(dim, matrix)`` by dimension and row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for dim, m in matrices(batch):
                    held[dim] = held.get(dim, 0) + f(dim, m)
            rows = [(dim, i, r) for dim, m in held.items() for i, r in enumerate(m)]
            arrays = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["dim", "row", "entries"])

        sent = whitened.select("dim", "whitened").mapInArrow(run, "dim int, row int, entries array<double>")
        cells = sent.select("dim", "row", F.posexplode("entries").alias("col", "v")).groupBy("dim", "row", "col").agg(F.sum("v").alias("v"))
        out: dict[tuple[int, int], np.ndarray] = {}
        for r in cells.collect():
            out.setdefault((r.dim, r.row), np.zeros(int(sound[r.dim].sum())))[r.col] = r.v
        return out

    means = {dim: v / models[dim].n for (dim, _), v in summed(lambda _, m: m.sum(axis=0, keepdims=True)).items()}
    products = summed(lambda dim, m: (m - means[dim]).T @ (m - means[dim]))
    return max((float(np.abs(v / models[dim].n - np.eye(len(v))[i]).max()) for (dim, i), v in products.items()), default=0.0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first 32 components of their exact covariance."""
    vectors = read_table(spark, sf_dir, "embeddings")
    models = fit_whitening(vectors)
    done = stored(whiten(vectors, models), "whitened")
    error = identity_error(done, models)
    shares = [(dim, k, float(s), error) for dim, m in models.items() for k, s in enumerate(m.explained[:COMPONENTS].tolist(), 1)]
    # One row a component of each length of vector: 32 for each.
    known = spark.createDataFrame(shares, "dim int, component int, explained double, identity_error double")
    rows = done.select("vec_id", "dim", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    rows = rows.select("vec_id", "dim", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened")
    return rows.join(F.broadcast(known), ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")

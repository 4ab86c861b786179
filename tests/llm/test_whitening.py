from fractions import Fraction

import numpy as np
import pytest

from lumera.llm import whitening
from lumera.llm.whitening import fit_whitening, identity_error, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, n string, digit int, deviation int, whitened string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "n", 3, 4, "w") for i, v in vectors], SCHEMA)


def exact(vectors, scale=64, shift=1_000_000):
    """Means, covariance and deviations by whole numbers and fractions."""
    x = [[int(np.floor(np.float64(c) * scale)) + shift for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = [[Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return n, s, cov, [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]


@pytest.mark.parametrize("size", [1.0, 1e7, 1e17, 1e30])
def test_exact_at_any_size(spark, size):
    """Covariance, deviations and coordinates agree with fractions, whether or not products fit in 64 bits."""
    r = np.random.default_rng(3)
    vectors = (size + r.normal(size=(300, 5)) * size / 10 * np.arange(1, 6)).tolist()
    df = table(spark, list(enumerate(vectors))).repartition(3)
    models = fit_whitening(df)
    n, s, cov, deviations = exact(vectors)
    m = models[5]
    assert (m.n, list(m.sums)) == (n, s) and m.trace == float(sum(cov[i][i] for i in range(5)))
    back = m.components * m.eigenvalues @ m.components.T
    want = np.array([[float(c) for c in row] for row in cov])
    assert np.abs(back - want).max() <= 1e-12 * want.max()
    got = {r.vec_id: r for r in whiten(df, models).collect()}
    assert [None if got[i].deviation is None else int(got[i].deviation) for i in range(n)] == [d if d < 10**38 else None for d in deviations]
    w = np.array([got[i].whitened for i in range(n)])
    assert np.abs(w.T @ w / n - np.eye(5)).max() < 1e-9
    assert identity_error(whiten(df, models), models) < 1e-9


def test_offset_that_doubles_lose(spark):
    """A mean of 10^12 with deviations of a few units: sums of squares in doubles would keep none of them."""
    r = np.random.default_rng(5)
    vectors = (1e12 + r.integers(-3, 4, (200, 3))).astype(float).tolist()
    m = fit_whitening(table(spark, list(enumerate(vectors))))[3]
    plain = fit_whitening(table(spark, [(i, [c - 1e12 for c in v]) for i, v in enumerate(vectors)]))[3]
    assert np.allclose(m.eigenvalues, plain.eigenvalues, rtol=1e-12) and m.trace == plain.trace


def test_rows_that_are_left_out_and_odd_tables(spark):
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.5]), (4, [0.25, 9.0])]
    odd = [(5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, float("-inf")]), (9, [])]
    df = table(spark, good + odd)
    models = fit_whitening(df)
    assert set(models) == {2} and models[2].n == 4
    rows = whiten(df, models).collect()
    assert sorted(r.vec_id if r.vec_id is not None else -1 for r in rows if r.dim == 2) == [-1, 1, 1, 4]
    _, _, _, deviations = exact([v for _, v in good])
    assert sorted(int(r.deviation) for r in rows) == sorted(deviations)
    # Two lengths are two fits; a length without a fit has no rows.
    both = table(spark, [*good, (10, [1.0]), (11, [2.0])])
    assert {d: m.n for d, m in fit_whitening(both).items()} == {1: 2, 2: 4}
    assert {r.dim for r in whiten(both, models).collect()} == {2}
    # Without variance there is nothing to divide by.
    flat = table(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])])
    m = fit_whitening(flat)
    assert m[2].sound.tolist() == [True, False] and all(r.whitened[1] is None and r.whitened[0] is not None for r in whiten(flat, m).collect())
    assert identity_error(whiten(flat, m), m) < 1e-12
    one = table(spark, [(1, [1.0, 5.0])])
    assert fit_whitening(one)[2].explained.tolist() == [0.0, 0.0]
    assert [r.whitened for r in whiten(one, fit_whitening(one)).collect()] == [[None, None]]
    none = table(spark, [])
    assert fit_whitening(none) == {} and whiten(none, {}).count() == 0 and identity_error(whiten(none, {}), {}) == 0.0


def test_query(spark, tmp_path):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(120, 40)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)] + [(500, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = whitening.op12_whitening(spark, str(tmp_path))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = df.collect()
    n, s, cov, deviations = exact(vectors.tolist())
    assert len(rows) == 120 * 32 and {(x.vec_id, x.deviation) for x in rows} == set(enumerate(deviations))
    values, columns = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    x = np.floor(vectors.astype(float) * 64) + 1_000_000 - np.array(s) / n
    got = np.zeros((120, 32))
    for row in rows:
        got[row.vec_id, row.component - 1] = row.whitened
        assert row.n == 120 and abs(row.explained - values[-row.component] / values.sum()) < 1e-12 and row.identity_error < 1e-9
    want = (x @ columns / np.sqrt(values))[:, ::-1][:, :32]
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8

import random
from collections import Counter

import numpy as np

from lumera.llm import toxicity
from lumera.llm.toxicity import LEAST_ROWS, OrdinalModel, drop_toxic, features, fit_ordinal, score_toxicity, train

from .helpers import SCHEMA, corpus, prose, table

LEVELS = [[], ["rude"], ["nasty", "vile"], ["hateful", "brutal", "cruel"]]


def graded(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g = i % 4
        words = prose(i + 1000 * seed, 60).split(" ")
        for w in [x for level in LEVELS[1 : g + 1] for x in level]:
            words[r.randrange(len(words))] = w
        rows.append((i, " ".join(words), g))
    return rows


def test_grades_are_ordered_and_held_out_severity_follows():
    rows, new = graded(400), graded(200, 1)
    model = fit_ordinal([features(t) for _, t, _ in rows], np.array([g for *_, g in rows]))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) >= 0).all()
    severity = model.severity([t for _, t, _ in new], {})
    means = [severity[[g == k for *_, g in new]].mean() for k in range(4)]
    assert all(b - a > 0.5 for a, b in zip(means[:-1], means[1:], strict=True)), means
    assert np.mean(np.rint(severity) == [g for *_, g in new]) > 0.85


def test_model_without_rows():
    model = fit_ordinal([], np.zeros(0, np.int64))
    assert model.weights == {} and len(model.thresholds) == 1


def test_filter_drops_what_is_toxic_and_keeps_the_rest(spark):
    rows = [(i, t, "en", "a") for i, t, _ in graded(200)]
    labels = spark.createDataFrame([(i, int(g > 0)) for i, _, g in graded(200)] + [(None, 1), (5, None), (999, 1), (4, 0)], "doc_id long, toxic int")
    clean = [(i + 10_000 if i is not None else None, *rest) for i, *rest in corpus()]
    docs = table(spark, rows + clean)
    model = train(docs, labels)
    got = {r.doc_id: r.toxic for r in score_toxicity(docs, model).collect()}
    assert np.mean([got[i] == (g > 0) for i, _, g in graded(200)]) > 0.97
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(i for (i,) in kept.select("doc_id").collect() if i is not None) == sorted([i for i, x in got.items() if i is not None and not x] + [10_025])
    assert not got[10_014] and not got[10_015] and not got[10_016]


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(table(spark, corpus()), none)
    assert not any(r.toxic for r in score_toxicity(table(spark, corpus()), model).collect())
    assert score_toxicity(spark.createDataFrame([], SCHEMA), model).count() == 0


def brute_fit(rows, grades, penalty):
    """The same loss brought down by plain proximal steps of one length with fixed momentum, on a dense matrix."""
    rows = [dict(zip(p.tolist(), v.tolist(), strict=True)) for p, v in rows]
    held = Counter(p for r in rows for p in r)
    places = sorted(p for p, n in held.items() if n >= LEAST_ROWS)
    x = np.array([[r.get(p, 0.0) for p in places] for r in rows])
    top = grades.max()
    above = grades[:, None] > np.arange(top)[None, :]
    weight = np.where(above, 0.5 / above.mean(axis=0), 0.5 / (1 - above.mean(axis=0))) / len(rows)

    def loss(w, t):
        m = (x @ w)[:, None] - t[None, :]
        return (weight * np.where(above, np.logaddexp(0, -m), np.logaddexp(0, m))).sum() + penalty * np.abs(w).sum()

    w, t = np.zeros(len(places)), np.zeros(top)
    step = 1 / (0.25 * np.linalg.norm(np.sqrt(weight.sum(axis=1))[:, None] * np.hstack([x, np.ones((len(x), 1))]), 2) ** 2 + 0.25 * weight.sum(axis=0).max())
    u, q = w, t
    for k in range(20_000):
        slope = weight * (1 / (1 + np.exp(-((x @ u)[:, None] - q[None, :]))) - above)
        new = u - step * (x.T @ slope.sum(axis=1))
        new, moved = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0), q + step * slope.sum(axis=0)
        u, q, w, t = new + k / (k + 3) * (new - w), moved + k / (k + 3) * (moved - t), new, moved
    return loss, places, w, t


def test_fit_of_four_grades_against_a_plain_minimiser():
    rows = graded(120)
    made, grades = [features(t) for _, t, _ in rows], np.array([g for *_, g in rows])
    model = fit_ordinal(made, grades, penalty=2e-2)
    loss, places, w, t = brute_fit(made, grades, 2e-2)
    ours = np.array([model.weights.get(p, 0.0) for p in places])
    assert set(model.weights) <= set(places) and len(model.thresholds) == 3
    assert abs(loss(ours, model.thresholds) - loss(w, t)) < 5e-3 * loss(w, t)
    # One weight vector for all thresholds: the chances of two thresholds differ by the same odds for every text.
    scores = np.array([model.score(text, {}) for _, text, _ in rows])
    odds = scores[:, None] - model.thresholds[None, :]
    assert np.allclose(odds[:, 0] - odds[:, 1], odds[0, 0] - odds[0, 1]) and (np.diff(model.thresholds) > 0).all()


def test_any_number_of_grades_and_conflicting_labels(spark):
    docs = table(spark, [(i, prose(i, 20) + f" g{i % 70}" * 3, "en", "a") for i in range(420)])
    labels = spark.createDataFrame([(i, 10 * (i % 70)) for i in range(420)] + [(7, 0), (7, 70), (-1, 9000), (8, -3)], "doc_id long, toxic int")
    model = train(docs, labels)
    assert model.levels.tolist() == list(range(0, 700, 10)) and len(model.thresholds) == 69
    got = score_toxicity(docs, model).collect()
    assert all(0 <= r.severity <= 690 and r.grade in model.levels for r in got)
    # The highest of conflicting grades counts.
    two = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    few = train(table(spark, [(i, "bad words here" if i == 1 else "good ones", "en", "a") for i in (1, 2, 3)]), two)
    assert few.levels.tolist() == [0, 1]


def test_repeated_rows_and_ties_are_judged_alike(spark):
    rows = [(i, t, "en", "a") for i, t, _ in graded(80)]
    docs = table(spark, rows + rows + [(None, rows[3][1], "en", "a")])
    model = train(docs, spark.createDataFrame([(i, int(g > 0)) for i, _, g in graded(80)], "doc_id long, toxic int"))
    by_text = {}
    for r in score_toxicity(docs, model).collect():
        by_text.setdefault(r.doc_id, set()).add((r.severity, r.toxic))
    assert all(len(x) == 1 for x in by_text.values())
    # A severity on the limit isn't rejected.
    assert not OrdinalModel({}, np.zeros(1), np.array([0, 1])).rejected(np.array([0.6]), 0.6)[0]


def test_fit_reaches_its_optimum_at_the_default_settings():
    """No word's slope leaves what the penalty allows, and long runs of plain proximal descent find nothing lower."""
    r = np.random.default_rng(8)
    rows = [(np.unique(r.integers(0, 120, 14)), None) for _ in range(400)]
    rows = [(p, r.random(len(p)) * (0.3 + 3 / (1 + p % 9))) for p, _ in rows]
    truth = r.normal(size=120) * (r.random(120) < 0.2) * 3
    score = np.array([truth[p] @ v for p, v in rows]) + r.normal(size=400)
    for grades in ((score > 1).astype(int), np.digitize(score, (-2, 0, 2))):
        model = fit_ordinal(rows, grades)
        x = np.zeros((400, 120))
        for i, (p, v) in enumerate(rows):
            x[i, p] = v
        levels = np.unique(grades)
        above = grades[:, None] > levels[:-1][None, :]
        share = above.mean(axis=0)
        weight = np.where(above, 0.5 / share, 0.5 / (1 - share)) / 400

        def loss(w, t):
            m = (x @ w)[:, None] - t
            return (weight * np.logaddexp(0, np.where(above, -m, m))).sum() + 5e-4 * np.abs(w).sum()

        w, t = np.zeros(120), np.zeros(len(levels) - 1)
        for at, v in model.weights.items():
            w[at] = v
        mine = loss(w, model.thresholds)
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - model.thresholds)))
        slope = x.T @ (weight * (p - above)).sum(axis=1)
        assert (np.abs(slope[w == 0]) <= 5e-4 * 1.01).all() and (np.abs(slope + 5e-4 * np.sign(w))[w != 0] <= 1e-5).all()
        v, s = np.zeros(120), np.zeros(len(levels) - 1)
        step = 1 / (0.25 * np.linalg.norm(np.hstack([x, np.ones((400, 1))]).T * weight.sum(axis=1) @ np.hstack([x, np.ones((400, 1))]), 2) * 2)
        for _ in range(20_000):
            q = 1 / (1 + np.exp(-((x @ v)[:, None] - s)))
            g = weight * (q - above)
            v = v - step * (x.T @ g.sum(axis=1))
            v = np.sign(v) * np.maximum(np.abs(v) - step * 5e-4, 0)
            s = np.maximum.accumulate(s + step * g.sum(axis=0))
        assert mine <= loss(v, s) + 1e-9


def test_documents_that_repeat_an_id_are_sampled_once(spark, monkeypatch):
    """A labelled id that many rows share brings one of them to the driver."""
    seen = []
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda pairs, grades, f=fit_ordinal: seen.append(len(pairs)) or f(pairs, grades))
    rows = [(1, f"vile vile {i}", "en", "s") for i in range(500)] + [(i, "kind words", "en", "s") for i in range(2, 40)]
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 40)], "doc_id long, toxic int")
    train(table(spark, rows), labels)
    assert seen == [39]

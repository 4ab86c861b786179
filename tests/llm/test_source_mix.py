import math
import random
from collections import Counter

import pytest

from lumera.llm import source_mix as module
from lumera.llm.source_mix import apply_mix, entropy_balance, source_mix, source_targets

from .helpers import SCHEMA, corpus, prose, table


def test_targets_share_out_and_stop_at_the_cap():
    t = source_targets({"b": 100, "a": 100, None: 1000, "c": 10})
    assert t["c"] == 20 and t["a"] == 200
    assert abs(sum(t.values()) - 1.5 * 1210) < 1e-6
    assert all(t[s] <= 2 * n + 1e-9 for s, n in {"b": 100, "a": 100, None: 1000, "c": 10}.items())
    assert source_targets({}) == {} and source_targets({"a": 0}) == {"a": 0.0}


def test_mix_comes_near_its_targets(spark):
    rows = [(i, prose(i, 5 + i % 90), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(600)] + corpus()
    docs = table(spark, rows)
    first = source_mix(docs, chunk=100).toPandas()
    again = source_mix(docs, chunk=100).toPandas()
    key = ["doc_id", "size", "row_no"]
    assert first.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()
    assert len(first) == len(rows) and (first["taken"] <= 2 * first["size"]).all()
    for _, group in first.groupby("source", dropna=False):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= max(60, 0.03 * group["target"].iloc[0], group["size"].max() / 2)


def test_applied_mix_repeats_rows(spark):
    docs = table(spark, [(i, prose(i, 50), "en", f"s{i % 4}") for i in range(80)])
    taken = {r.doc_id: r.copies for r in source_mix(docs).collect()}
    got = apply_mix(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: v for k, v in taken.items() if v})


def test_empty_table(spark):
    assert source_mix(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_dual(cells, target, cap):
    """The tilt that takes ``target`` words of (prior, tokens) cells, by halving."""
    taken = lambda d: sum(t * min(cap, q * math.exp(d)) for q, t in cells)
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if taken(mid) < target else (low, mid)
    return low


def test_newton_against_halving(spark):
    r = random.Random(4)
    cells = {f"s{i}": [(r.choice([0.01, 0.3, 0.5, 1.0, 2.5, 40.0]) + 0.001 * k, float(r.randint(1, 9000))) for k in range(r.randint(1, 7))] for i in range(25)}
    target = {s: r.choice([0.02, 0.3, 1.0, 1.7, 1.99, 2.0]) * sum(t for _, t in c) for s, c in cells.items()}
    frame = spark.createDataFrame([(s, q, t) for s, c in cells.items() for q, t in c], "source_key string, prior double, tokens double")
    dual = entropy_balance(frame, spark.createDataFrame(list(target.items()), "source_key string, target double"))
    for s, c in cells.items():
        rates = [min(2.0, q * math.exp(dual[s])) for q, _ in c]
        want = [min(2.0, q * math.exp(brute_dual(c, target[s], 2.0))) for q, _ in c]
        assert max(abs(a - b) for a, b in zip(rates, want, strict=True)) < 1e-6, s
        # Rates that aren't capped are the prior times one factor: the exponential tilt.
        factors = [a / q for a, (q, _) in zip(rates, c, strict=True) if a < 2.0]
        assert not factors or max(factors) / min(factors) < 1 + 1e-9


@pytest.mark.parametrize("hot", [10_000, 20])
def test_partitioning_changes_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(module, "HOT_KEY", hot)
    rows = [(i, prose(i, 1 + i % 70), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    rows += [(None, f"one two {i % 4}", "en", None) for i in range(120)] + [(5, "again and again", "en", "hot")] * 90 + corpus()
    docs = table(spark, rows)
    seen = []
    for n in (3, 7):
        got = source_mix(docs.repartition(n), chunk=100).toPandas()
        assert len(got) == len(rows) and not got["row_no"].duplicated().any()
        seen.append(Counter((str(r.doc_id), r.size, str(r.source), r.taken) for r in got.itertuples()))
    assert seen[0] == seen[1]
    equal = [n for (i, size, s, _), n in seen[0].items() if (i, size, s) == ("5.0", 3, "hot")]
    assert sum(equal) == 90


def test_clashing_names_and_null_ids(spark):
    docs = table(spark, [(None if i % 3 else i, prose(i, 30), "en", f"s{i % 4}") for i in range(60)]).selectExpr("*", "1 AS _mix_id", "2 AS _copy", "3 AS _copies", "4 AS `a.b`", "5 AS _row")
    got = apply_mix(docs)
    assert got.columns == docs.columns
    assert got.count() == sum(r.copies for r in source_mix(docs).collect()) and got.where("doc_id IS NULL").count() > 30


def test_priors_of_any_size_are_met(spark):
    """Far-off and far-apart priors need many rounds, and get them; what can't be met is at the cap."""
    cells = {"far": [(1e100, 100.0)], "tiny": [(1e-200, 70.0), (1e-190, 30.0)], "apart": [(10.0**k, 10.0) for k in range(-120, 121, 8)], "over": [(0.5, 10.0), (3.0, 5.0)], "nothing": [(1.0, 5.0)], "void": []}
    target = {"far": 50.0, "tiny": 140.0, "apart": 333.0, "over": 31.0, "nothing": 0.0, "void": 0.0}
    frame = spark.createDataFrame([(s, q, t) for s, c in cells.items() for q, t in c], "source_key string, prior double, tokens double")
    dual = entropy_balance(frame, spark.createDataFrame(list(target.items()), "source_key string, target double"))
    assert set(dual) == set(target)
    taken = {s: sum(t * min(2.0, math.exp(min(700.0, math.log(q) + dual[s]))) for q, t in c) for s, c in cells.items()}
    assert taken["over"] == 30.0 and taken["nothing"] == 0.0
    assert all(abs(taken[s] - target[s]) <= 1e-6 * target[s] for s in ("far", "tiny", "apart"))
    assert entropy_balance(frame.limit(0), spark.createDataFrame([], "source_key string, target double")) == {}

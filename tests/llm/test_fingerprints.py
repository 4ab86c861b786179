import hashlib
import re

import numpy as np
import pyarrow as pa

from lumera.llm.fingerprints import containment, distinct, fingerprint, from_text, likeness, merge, merge_fingerprints, op5_fingerprints, resemblance, sketches, to_text
from lumera.llm.shingles import word_hashes

from .helpers import SCHEMA, corpus, prose, table


def shingles(text, k=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_sketches_hold_small_sets_exactly():
    a, b = prose(1, 60), prose(1, 60)[:200] + prose(2, 40)
    s, t = sketches([a.encode(), b.encode()], k=1000)
    x, y = shingles(a), shingles(b)
    assert len(s) == len(x) == distinct(s, 1000)
    assert resemblance(s, t, 1000) == len(x & y) / len(x | y)
    assert abs(containment(s, t, 1000) - len(x & y) / len(x)) < 1e-9
    assert (from_text(to_text(s)) == s).all()


def test_merge_is_the_sketch_of_the_union():
    parts = [prose(i, 400).encode() for i in range(4)]
    whole = np.unique(np.concatenate(sketches(parts, k=10_000)))[:128]
    assert (merge(sketches(parts)) == whole).all()
    assert abs(distinct(whole) / len(set().union(*(shingles(p.decode()) for p in parts))) - 1) < 0.35


def test_words_across_windows(monkeypatch):
    from lumera.llm import shingles as module

    texts = [prose(i, 50).encode() for i in range(5)] + [b"x" * 300, b"", b" a  b "]
    whole = word_hashes(texts)
    monkeypatch.setattr(module, "WINDOW", 64)
    cut = word_hashes(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert whole[1][-1] == sum(len(t.split()) for t in texts)


def test_query_against_brute_force(spark, tmp_path):
    rows = [r for r in corpus() if r[0] not in (None, 25)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for n, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        x, y, z = shingles(t), shingles(edited), shingles(after)
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - near(x, y)) < 0.2 and abs(r.near_next - near(x, z)) < 0.2
    assert got[10].fingerprint == got[11].fingerprint and len(got) == len(rows)


def test_many_ranges_and_an_id_that_holds_a_third(spark, monkeypatch):
    from lumera.llm import fingerprints

    monkeypatch.setattr(fingerprints, "RANGE", 7)
    rows = [(i, f"text {i}", "en", "a") for i in range(0, 300, 3)] + [(None, f"none {i}", "en", "a") for i in range(60)] + [(33, f"again {i}", "en", "a") for i in range(20)]
    pair = lambda ids, texts, nexts: pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, "int64"), "text": texts, "next": nexts})
    got = fingerprints.with_next(table(spark, rows), pair, "doc_id long, text string, next string").collect()
    assert sorted(r.text for r in got) == sorted(t for _, t, *_ in rows)
    after = {r.text: r.next for r in got}
    # One ring through all rows, ids falling along it and null last.
    ring, at = [], "text 297"
    while not ring or at != "text 297":
        ring.append(at)
        at = after[at]
    ids = {t: -1 if i is None else i for i, t, *_ in rows}
    assert len(ring) == len(rows) and [ids[t] for t in ring] == sorted(ids.values(), reverse=True)


def test_places_among_five_thousand_ranges():
    from lumera.llm.fingerprints import order_keys, places

    r = np.random.default_rng(5)
    edge = [-(1 << 63), -1, 0, 1, (1 << 63) - 1]
    ids = np.concatenate([r.integers(-50, 50, 20_000), r.integers(-(1 << 62), 1 << 62, 20_000), np.repeat(edge, 5)])
    hashes = np.concatenate([r.integers(-(1 << 63), (1 << 63) - 1, 40_000), np.tile(edge, 5)])
    order = sorted(zip(ids.tolist(), hashes.tolist(), strict=True), key=lambda k: (-k[0], k[1]))
    keys = order_keys(*(np.array(c, np.int64) for c in zip(*order, strict=True)))
    assert (np.sort(keys) == keys).all()
    begin = np.unique(np.append(r.choice(len(order), 5_000, replace=False), 0))
    begin = begin[[i == 0 or order[i] != order[i - 1] for i in begin]]
    at, guest = places(keys[begin], keys)
    assert (at == np.searchsorted(begin, np.arange(len(keys)), side="right") - 1).all()
    first = {order[i]: k for k, i in enumerate(begin)}
    assert all(g == ((first[k] - 1) % len(begin) if k in first else -1) for g, k in zip(guest, order, strict=True))


def test_plan_does_not_grow_with_the_ranges(spark, monkeypatch):
    from lumera.llm import fingerprints

    rows = [(i, f"text {i}", "en", "a") for i in range(400)]
    pair = lambda ids, texts, nexts: pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, "int64"), "next": nexts})
    size = []
    for many in (100, 4):
        monkeypatch.setattr(fingerprints, "RANGE", many)
        found = fingerprints.with_next(table(spark, rows), pair, "doc_id long, next string")
        size.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
        assert sorted((r.doc_id, r.next) for r in found.collect()) == [(i, f"text {(i - 1) % 400}") for i in range(400)]
    assert abs(size[1] - size[0]) < 50


def test_columns_groups_and_empty_table(spark, tmp_path):
    docs = table(spark, corpus())
    marks = fingerprint(docs)
    assert marks.count() == len(corpus())
    merged = merge_fingerprints(marks.selectExpr("doc_id % 2 AS part", "fingerprint"), "part").collect()
    assert {r.part for r in merged} == {0, 1, None}
    same = marks.alias("x").join(marks.alias("y"), "doc_id").select(likeness("x.fingerprint", "y.fingerprint").alias("s"))
    assert same.where("s < 1").count() == 0
    table(spark, corpus()).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert op5_fingerprints(spark, f"{tmp_path}/a").count() == len(corpus())
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op5_fingerprints(spark, f"{tmp_path}/b").count() == 0

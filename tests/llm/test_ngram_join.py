import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from lumera.llm import components, ngram_join
from lumera.llm.components import connected_components
from lumera.llm.ngram_join import bands, drop_near_copies, jaccard_groups, jaccard_links, needed, prefix_length

from .helpers import SCHEMA, corpus, prose, table


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for n, (i, *_) in enumerate(rows):
        if i is not None:
            groups[find(n)] = min(groups.get(find(n), i), i)
    return sorted(((i, len(sets[n]), groups.get(find(n)) if sets[n] else i) for n, (i, *_) in enumerate(rows)), key=str)


def edited(n, seed=0):
    """Near copies of a few texts with so many edits that similarities lie about the threshold, in chains."""
    r, rows = random.Random(seed), []
    for i in range(n):
        words = prose(900 + i % 4, 150).split(" ")
        for _ in range(r.randint(0, 8)):
            words[r.randrange(len(words))] = f"edit{r.randint(0, 9)}"
        rows.append((500 + i, " ".join(words[: 150 - r.randint(0, 12)]), "en", "a"))
    return rows


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_against_brute_force(spark, words, percent):
    rows = corpus() + edited(120)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, rows), words=words, percent=percent).collect()]
    assert sorted(got, key=str) == brute(rows, words, percent)


def brute_links(rows, words, percent):
    sets = {}
    for i, t, *_ in rows:
        if s := shingles(t, words):
            sets.setdefault(s, []).append(i)
    return [(x, y) for x, y in itertools.combinations(sets, 2) if 100 * len(x & y) >= percent * len(x | y)], sets


@pytest.mark.parametrize(("part", "visitors", "percent"), [(1_000, 20, 80), (5, 2, 70)])
def test_all_links_against_brute_force(spark, monkeypatch, part, visitors, percent):
    monkeypatch.setattr(ngram_join, "PART_SETS", part)
    monkeypatch.setattr(ngram_join, "VISITORS", visitors)
    rows = [r for r in corpus() if r[0] is not None] + edited(90, 2)
    pairs, sets = brute_links(rows, 4, percent)
    docs = table(spark, rows)
    got = [tuple(sorted((r.doc_a, r.doc_b))) for r in jaccard_links(docs, words=4, percent=percent).collect()]
    assert sorted(got) == sorted(tuple(sorted((min(sets[x]), min(sets[y])))) for x, y in pairs) and len(got) > 100
    n = Counter(i for pair in pairs for s in pair for i in sets[s])
    repeated = Counter(i for i, *_ in rows)
    for r in jaccard_groups(docs, words=4, percent=percent).collect():
        assert r.n_links == n[r.doc_id] // repeated[r.doc_id], r.doc_id


def test_a_group_sends_numbers_and_not_links(spark, monkeypatch):
    """20 parts of a group of near copies, all of them linked: one row a set, where the links are thousands."""
    monkeypatch.setattr(ngram_join, "PART_SETS", 20)
    words = prose(77, 100).split(" ")
    docs = spark.createDataFrame([(i, zstandard.compress(" ".join([*words, f"copy{i}"]).encode()), 98) for i in range(400)], "short long, z binary, n int")
    groups = docs.selectExpr("short AS node", "7L AS `group`")
    found = ngram_join.within(groups, docs.drop("z"), docs.drop("n"), 4, 85, False)
    sent = found._jdf.queryExecution().optimizedPlan().children().head()  # what is aggregated
    assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent).count() == 400
    assert {r.node: r.n_links for r in found.collect()} == dict.fromkeys(range(400), 399)
    pairs = ngram_join.within(groups, docs.drop("z"), docs.drop("n"), 4, 85, True).collect()
    assert sorted(map(tuple, pairs)) == list(itertools.combinations(range(400), 2))


def test_long_lists_in_parts_and_without_stars(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 7)
    monkeypatch.setattr(ngram_join, "bands", lambda s: [int(s[0] >> np.uint64(1)) + i for i in range(8)] if len(s) else [])
    rows = edited(60, 1)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, rows), words=4, percent=85).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85)


def test_a_passage_that_crowded_counters_hide_makes_no_pairs(spark, monkeypatch):
    """80 texts share a passage, but no prefix holds it, though its counters are within a few averages of all others."""
    monkeypatch.setattr(ngram_join, "SKETCH", 1 << 10)
    candidates, made = ngram_join.candidates, []

    def counted(*args):
        made.append(candidates(*args))
        return made[-1]

    monkeypatch.setattr(ngram_join, "candidates", counted)
    passage = prose(5, 40)
    rows = [(i, " ".join([*(f"w{i}x{k}" for k in range(200)), passage]), "en", "a") for i in range(80)]
    got = jaccard_groups(table(spark, rows), words=4, percent=85).collect()
    assert [pairs.count() for pairs in made] == [0, 0]
    assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got} == {(i, 237, i, 0) for i in range(80)}


def test_sizes():
    for n in range(1, 60):
        for m in range(n, 80):
            a = int(needed(n, m, 85))
            assert 100 * a >= 85 * (n + m - a) and not 100 * (a - 1) >= 85 * (n + m - a + 1)
        assert 1 <= prefix_length(n, 85) <= n
    assert len(bands(np.arange(5, dtype=np.uint64))) == 8


def grouped(labels):
    """Components as sets of nodes; a label is one of them."""
    out = {}
    for r in labels.collect():
        out.setdefault(r.label, set()).add(r.node)
    assert all(label in nodes for label, nodes in out.items())
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("few", [400_000, 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    label = list(range(1000, 1300))
    random.Random(3).shuffle(label)
    path = [(i, i + 1) for i in range(100)]
    star = [(2000, 2000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(path + list(zip(label[:-1], label[1:], strict=True)) + star + star[:9] + [(200, 201), (7, 7), (5, 3)], "a long, b long")
    want = [list(range(101)), [200, 201], list(range(1000, 1300)), list(range(2000, 2050))]
    assert grouped(connected_components(edges)) == want
    named = edges.selectExpr("'n' || a AS a", "'n' || b AS b")
    assert grouped(connected_components(named)) == sorted(sorted(f"n{i}" for i in nodes) for nodes in want)
    assert connected_components(edges.where("a < 0")).count() == 0


def test_filter_and_empty_table(spark):
    docs = table(spark, corpus())
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [10, 14, 15, 16, 17, 19, 20, 21, 22, 23, 24, 26]
    assert jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0

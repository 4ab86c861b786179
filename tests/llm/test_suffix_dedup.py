import random
from collections import Counter

import numpy as np
import pytest

from lumera.llm import suffix_dedup
from lumera.llm.suffix_dedup import remove_repeats

from .helpers import SCHEMA, corpus, prose, table


def brute(rows, length):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(b), kept, [(int(x), int(y)) for x, y in edge.reshape(-1, 2)]))
    return out


def check(spark, rows, length=200):
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in remove_repeats(table(spark, rows).repartition(3), length=length).collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, length), key=key)


def edits():
    r, base = random.Random(5), prose(50, 400)
    rows = []
    for i in range(40):
        words = base.split(" ")
        for _ in range(i % 5):
            words[r.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words[r.randrange(60) :]), "en", "a"))
    line = "This very common line stands in a great many of the documents and is longer than the strings that are looked for, " * 2
    return rows + [(100 + i, prose(100 + i, 30) + "\n" + line + "\n" + prose(300 + i, 30), "en", "a") for i in range(60)]


def test_against_brute_force(spark):
    check(spark, corpus() + edits())


def test_buckets_spread_by_window_and_cut_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LOCAL", 2)
    check(spark, corpus() + edits(), 150)


@pytest.mark.parametrize("text", ["ab" * 700, "x" * 1000, "abc" * 66 + "ab"])
def test_periodic_texts(spark, text):
    check(spark, [(1, text, None, None), (2, "q" + text[:250], None, None)])


def test_refinement_decides_windows():
    """Runs that share 8, 64 and 150 bytes stand in one bucket until refinement parts them; the rest agrees byte by byte."""
    r = random.Random(1)
    some = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    shared = some(260)
    runs = [some(40) + shared[:k] + some(300 - 40 - k) for k in (8, 64, 150, 220, 260)] + [some(300) for _ in range(3)]
    windows = np.array([len(t) - 199 for t in runs])
    trace = []
    run, place = suffix_dedup.refine(runs, windows, 200, trace)
    count = Counter(t[i : i + 200] for t, n in zip(runs, windows, strict=True) for i in range(n))
    want = {(k, i) for k, (t, n) in enumerate(zip(runs, windows, strict=True)) for i in range(n) if count[t[i : i + 200]] > 1}
    assert set(zip(run.tolist(), place.tolist(), strict=True)) == want and want
    depths, left = zip(*trace, strict=True)
    # Every depth parts windows that the one before held together.
    assert depths == (8, 16, 32, 64, 128, 200) and all(a > b for a, b in zip(left[3:-1], left[4:], strict=True)) and left[-1] == len(want)


@pytest.mark.parametrize("length", [128, 150, 200, 256, 300])
def test_refinement_against_brute_force(length):
    r = random.Random(length)
    text = "".join(r.choice("ab") for _ in range(40))
    runs = [("".join(r.choice([text, text[::-1], "ab", "b"]) for _ in range(60)))[: length + 90].encode() for _ in range(12)]
    windows = np.array([len(t) - length + 1 for t in runs])
    count = Counter(t[i : i + length] for t, n in zip(runs, windows, strict=True) for i in range(n))
    want = [(k, i) for k, (t, n) in enumerate(zip(runs, windows, strict=True)) for i in range(n) if count[t[i : i + length]] > 1]
    assert list(zip(*(x.tolist() for x in suffix_dedup.refine(runs, windows, length)), strict=True)) == want


def test_hot_keys_are_broadcast(spark, monkeypatch):
    from lumera.llm import common

    monkeypatch.setattr(common, "HOT_KEY", 5)
    check(spark, corpus() + edits())


def test_segments_cover_every_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    text = prose(3, 900).encode()
    seen = np.zeros(len(text), int)
    for _, first, n, *_ in suffix_dedup.runs([b"short", text], 200):
        for a, k in zip(first, n, strict=True):
            seen[a : a + k] += 1
    assert (seen[: len(text) - 199] == 1).all() and not seen[len(text) - 199 :].any()


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0

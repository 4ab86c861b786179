import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lumera.llm import collocations as c
from tests.llm.helpers import corpus, prose, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, longest=3, least=10, percent=50, most=2_000):
    """The rows of collocations() by plain loops; rows of (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    out, best = [], {}
    for (lang, w), a in counts.items():
        if a >= least:
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    key = lang, w[i : i + size]
                    best[key] = max(best.get(key, 0), a)
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= least and 100 * best.get((lang, w), -1) < percent * a:
            score, _, l, r = min((10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, l, r, totals[lang], score))
    done = []
    for lang in {r[0] for r in out}:
        part = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        done += [(lang, i, *r[1:]) for i, r in enumerate(part[:most], 1)]
    return sorted(done)


def found(df):
    return sorted(tuple(r[n] for n in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def docs(spark, rows):
    return table(spark, [(i, text, lang, "s") for i, (lang, text) in enumerate(rows)])


def some_rows():
    rows = [(lang, text) for _, text, lang, _ in corpus()]
    rows += [("en", f"alpha beta gamma. Alpha beta, x{i} alpha BETA gamma\tdelta") for i in range(12)]
    rows += [(None, "Über die Straße; über die straße!  Über\tdie Straße? ÜBER die Straße\x0bdie die die die") for _ in range(6)]
    rows += [("de", "a a a a a a a a a a a a a a"), ("de", "...,,,"), ("de", " \t "), ("und", "über die straße")]
    return rows


@pytest.mark.parametrize("width", [None, 1 << 16, 8])
def test_against_plain_loops(spark, width):
    """The same rows whatever the sketch lets through: even if it lets everything through."""
    rows = some_rows()
    for longest, least in ((3, 10), (2, 3), (5, 4)):
        assert found(c.collocations(docs(spark, rows).repartition(3), longest, least, width=width)) == expected(rows, longest, least)
    assert found(c.collocations(docs(spark, rows), 3, 2, most=5)) == expected(rows, 3, 2, most=5)


def test_portions_of_long_texts(spark, monkeypatch):
    """Texts that are cut into many portions, between words anywhere, give the same counts."""
    rows = [("en", prose(1, 4_000)), ("fr", ("one two three four, " * 500).upper()), ("en", "w" * 300 + " w w " * 50), ("en", prose(1, 50))]
    monkeypatch.setattr(c, "WINDOW", 64)
    monkeypatch.setattr(c, "BATCH_WORDS", 40)
    assert found(c.collocations(docs(spark, rows), 4, 5)) == expected(rows, 4, 5)


def test_thresholds_beyond_a_byte(spark):
    """Counters of a byte stand for several occurrences when more than 255 are asked for."""
    rows = [("en", "p q r " * 301), ("en", "p q"), ("en", "s t " * 299 + " v")]
    for least in (299, 300, 302):
        assert found(c.collocations(docs(spark, rows).repartition(2), 3, least)) == expected(rows, 3, least)


def test_ranks_of_ties(spark):
    rows = [("en", f"{w} {w}x. " * 10) for w in ("b", "ä", "a", "c")]
    assert [r[2] for r in found(c.collocations(docs(spark, rows), 2, 10))] == ["a ax", "b bx", "c cx", "ä äx"]


def test_exact_products(spark):
    """Squares of counts beyond 64 bits."""
    a, l, r = 3_000_000_019, 4_000_000_007, 3_500_000_057
    counts = spark.createDataFrame([("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, words int, phrase string, f long")
    (got,) = c.score_phrases(counts).collect()
    assert (got.a, got.l, got.r, got.score) == (a, l, r, 10**6 * a * a // (l * r))


def test_empty_tables(spark):
    assert found(c.collocations(docs(spark, []))) == [] and found(c.collocations(docs(spark, [("en", None), (None, "")]))) == []


def test_sql(spark):
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("the driver's tables aren't here")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    want = con.sql(c.OP13_SQL)
    at = [want.columns.index(n) for n in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    assert found(c.op13_collocations(spark, str(data))) == sorted(tuple(r[i] for i in at) for r in want.fetchall())

import hashlib
import re

from lumera.llm.exact_dedup import drop_exact_copies, exact_dedup

from .helpers import SCHEMA, corpus, table


def brute(rows):
    out, groups = [], {}
    for n, (i, t, *_) in enumerate(rows):
        norm = re.sub("[\x20\x09-\x0d]", "", t or "")
        groups.setdefault(norm, []).append((-len(t or ""), i is None, i or 0, n))
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            i = None if m[1] else m[2]
            out.append((i, None if best[1] else best[2], len(members), m[3] == best[3], hashlib.sha256(norm.encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    rows = corpus() + [(i, f"copy  {'of ' * (i % 3)}one", "en", "a") for i in range(100, 140)]
    got = exact_dedup(table(spark, rows).repartition(5), fan_in=2).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_keeps_columns_and_one_row_of_each_text(spark):
    docs = table(spark, corpus())
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [10, 12, 16, 17, 19, 20, 21, 22, 23, 24, 25, 26] and None in ids

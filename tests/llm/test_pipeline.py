from collections import Counter

import corpus_pipeline
from lumera.llm import source_mix

from .helpers import corpus, prose, table


def test_stages_and_run(spark, tmp_path):
    toxic = [(300 + i, prose(300 + i, 40) + (" horrid vile" if i % 4 == 0 else ""), "en", f"s{i % 3}") for i in range(80)]
    table(spark, [r for r in corpus() if r[0] is not None] + toxic).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(300 + i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, before = docs.columns, None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert not ids & {300 + i for i in range(0, 80, 4)} and len(ids) == 18 - 1 + 60
        if name == "exact_dedup":
            assert not {11, 13, 18} & ids
        if name == "ngram_join":
            assert not {12, 25} & ids
    assert {r.doc_id for r in before.select("doc_id").collect()} == ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_rows_with_null_and_repeated_ids(spark, tmp_path):
    near = prose(50, 100).split(" ")
    near[40] = "changed"
    rows = [r for r in corpus() if (r[1] or "").strip()] + [
        (3, prose(50, 100), "en", "a"),
        (7, " ".join(near), "en", "a"),  # a near copy of 3
        (7, prose(51, 80), "en", "a"),  # another text of the same id
        (None, " ".join(near[:-1]), "en", "b"),  # a near copy of 3 and 7
        (None, prose(52, 70), "en", "b"),
        (None, prose(52, 70), "en", "b"),
        (None, prose(53, 90), "en", "c"),
    ]
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for docs in (table(spark, rows), spark.read.parquet(f"{tmp_path}/documents.parquet")):
        once = stages["exact_dedup"](spark, docs, "")
        texts = Counter("".join(r.text.split()) for r in once.collect())
        assert once.columns == docs.columns and texts == Counter({"".join(t.split()) for _, t, *_ in rows})
        kept = stages["ngram_join"](spark, once, "")
        found = Counter((r.doc_id, r.text) for r in kept.collect())
        gone = {" ".join(near), " ".join(near[:-1]), rows[2][1]} | {t for i, t, *_ in rows if i == 25}
        assert {t for _, t in found} == {t for t in (r.text for r in once.collect()) if t not in gone} and set(found.values()) == {1}
        assert (7, prose(51, 80)) in found and (None, prose(53, 90)) in found and (3, prose(50, 100)) in found
        mixed = stages["source_mix"](spark, kept, "")
        taken = Counter(r.text for r in mixed.collect())
        want = {r.row_no: r for r in source_mix.source_mix(kept).collect()}
        assert sum(taken.values()) == sum(r.copies for r in want.values()) and None in {r.doc_id for r in mixed.collect()}


def test_repeated_ids_do_not_overshoot_the_mix(spark):
    docs = table(spark, [(1, prose(i, 20 + i), "en", f"s{i % 3}") for i in range(60)])
    taken = Counter({prose(i, 20 + i): 0 for i in range(60)})
    taken.update(r.text for r in source_mix.apply_mix(docs).collect())
    want = source_mix.source_mix(docs).collect()
    assert Counter(len(t.split()) for t, n in taken.items() for _ in range(n)) == Counter(r.size for r in want for _ in range(r.copies))


def test_empty_table_and_clashing_names(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    names = ["_gone", "_keep_id", "_row", "_copy", "_mix_id", "_ROW_FILE", "label", "component_id", "a.b", "place", "key"]
    docs = table(spark, corpus()).selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    for folder, rows in (("full", docs), ("none", docs.limit(0))):
        rows.repartition(2).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        at = spark.read.parquet(f"{tmp_path}/{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, f"{tmp_path}/{folder}")
            assert at.columns == rows.columns, name
        got = corpus_pipeline.run(spark, f"{tmp_path}/{folder}")
        assert (got.count() == 0) == (folder == "none")
    none = {r.doc_id for r in got.collect()}
    assert not none

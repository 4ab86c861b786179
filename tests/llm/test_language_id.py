import random
import re
from collections import Counter

import numpy as np

from lumera.llm.language_id import SWITCH, LanguageModel, held_out, op7_language_id, predict, train

from .helpers import SCHEMA, table

PARTS = {"en": ["the", "ing", "th", "ould", "wh", "ness"], "de": ["sch", "ung", "ein", "ver", "ö", "keit"], "ru": ["ов", "ский", "при", "ше", "ние"]}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows(n=240):
    return [(i, text(("en", "de", "ru")[i % 3], 30, i), ("en", "de", "ru")[i % 3], "a") for i in range(n)]


def brute_path(score, switch):
    best, back = [score[0]], []
    for s in score[1:]:
        step = [[b - switch * (i != j) for i, b in enumerate(best[-1])] for j in range(len(s))]
        back.append([int(np.argmax(x)) for x in step])
        best.append([max(x) + y for x, y in zip(step, s, strict=True)])
    return best[-1]


def test_viterbi_against_brute_force(spark):
    model = train(table(spark, rows()))
    mixed = [text("en", 12, 1) + " " + text("de", 12, 2), "", text("ru", 3, 3), text("de", 1, 4) + " " + text("en", 9, 5)]
    words = [t.split() for t in mixed]
    for own, path in zip(words, model.label(words, 4.0), strict=True):
        if not own:
            assert len(path) == 0
            continue
        score = model.scores(own)
        total = sum(score[i, p] for i, p in enumerate(path)) - 4.0 * np.count_nonzero(np.diff(path))
        assert abs(total - max(brute_path(score, 4.0))) < 1e-3


def test_held_out_accuracy_and_undetermined_texts(spark, tmp_path):
    odd = [(1000 + 10 * k, t, "en", "a") for k, t in enumerate(["\u00bd \u00b2", "\u2460 \u2461", "\u2163 12", "7\u00bd"], 1)] + [(1000, None, "en", "a"), (1001, "", None, "a"), (1002, "12 34 !?", "de", "a"), (1003, text("en", 4000, 9), None, "a"), (None, text("de", 20, 8), None, "a")]
    table(spark, rows() + odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op7_language_id(spark, str(tmp_path)).collect()}
    truth = {i: lang for i, _, lang, _ in rows()}
    outside = [i for i in truth if got[i].held_out]
    assert len(outside) > 40 and np.mean([got[i].lang_pred == truth[i] for i in outside]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "de"]
    assert [(got[1000 + 10 * k].lang_pred, got[1000 + 10 * k].score) for k in range(1, 5)] == [("und", 0.0)] * 4
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == 0


def test_spans_of_mixed_text(spark):
    model = train(table(spark, rows()))
    r = predict(table(spark, [(1, text("en", 25, 1) + ". " + text("de", 25, 2), None, None)]), model).first()
    assert [s.lang for s in r.spans] == ["en", "de"] and abs(r.spans[0].end - 25) <= 2


def test_nothing_learned_and_empty_table(spark):
    model = train(table(spark, []))
    assert model.langs == [] and {r.lang_pred for r in predict(table(spark, rows(3)), model).collect()} == {"und"}
    assert predict(spark.createDataFrame([], SCHEMA), LanguageModel([], np.zeros((0, 1)), np.zeros((0, 1)))).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    """Labels and scores of whole texts by a path search over all words, one text at a time; repeated rows and ties."""
    mixed = [(500 + i, text("en", 5 + i, i) + " " + text("de", 15 - i, i) + " \u00bd 12 " + text("ru", i % 3, i), None, "a") for i in range(12)]
    twins = [(700, text("de", 6, 1), "de", "a"), (700, text("de", 6, 1), "de", "a"), (None, "zz zz", None, "a"), (None, "zz zz", None, "a")]
    table(spark, rows() + mixed + twins).write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_language_id(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = train(docs.where(~held_out(docs["doc_id"])))
    want = []
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        words = [w for w in words if any(c.isalpha() for c in w)]
        score = model.scores(words)
        best, back = score[0].copy(), []
        for s in score[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - np.float32(SWITCH)
            back.append([j if stay[j] else top for j in range(len(s))])
            best = np.where(stay, best, best[top] - np.float32(SWITCH)) + s
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(step[path[-1]])
        letters = Counter()
        for w, j in zip(words, reversed(path), strict=True):
            letters[j] += len(w)
        pred = min(letters, key=lambda j: (-letters[j], j))
        want.append((str(r.doc_id), model.langs[pred], round(letters[pred] / sum(letters.values()), 9)))
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in got) == sorted(want)

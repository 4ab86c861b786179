"""Small corpora for the tests of the text operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row_no string, kept string, n int, bucket string, copies string, z binary"
WORDS = "the of amber lion counts seven rivers while every quiet morning brings new light over old stone houses near harbour walls".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "ed"]) + str(r.randint(0, 40)) * (r.random() < 0.4) for _ in range(n))


def table(spark, rows):
    """Rows of (doc_id, text, lang, source); further columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 7, "x", "y", 1, "b", "c", b"z") for i, t, lang, source in rows], SCHEMA)


def corpus() -> list[tuple]:
    """Nulls, empty and blank texts, copies, near copies, shared passages, long texts, repeated rows."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (10, base, "en", "a"),
        (11, base, "en", "a"),
        (12, " ".join(near), "en", "b"),
        (13, base.replace(" ", "\n"), None, "b"),
        (14, None, "en", None),
        (15, "", None, None),
        (16, " \t\n\x0b\x0c\r ", "en", "c"),
        (17, "one two", "en", "c"),
        (18, "one two", "en", "c"),
        (19, prose(3, 40) + " " + passage + " " + prose(4, 50), "en", "a"),
        (20, prose(5, 10) + " " + passage, "de", "a"),
        (21, "naïve über Straße 漢字 " + prose(6, 30), "de", "é"),
        (22, prose(7, 6000), "fr", "b"),
        (23, "a" * 450, None, "b"),
        (24, prose(8, 1500) + passage.upper(), "fr", "z"),
        (25, base + " tail", "en", "b"),
        (25, base + " tail", "en", "b"),
        (None, prose(9, 30), "en", "a"),
        (26, prose(10, 300), "en", "a"),
    ]

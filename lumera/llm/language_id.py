"""Language identification with spans for mixed text.

Every word gets a score in each language from character n-grams; languages that
aren't written in the word's script are ruled out first. A Viterbi pass over the
words with a penalty for each change of language then labels spans, and a text's
language is the one that labels most of its letters.

Training counts words per language over all training documents on Spark, then
n-grams over the distinct words. The driver holds one table of ``2 ** BITS``
log-probabilities per language, whatever the size of the corpus.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.llm.common import read_table, small, text_or_empty
from lumera.llm.shingles import mix

#: Hashed n-grams of each language; lengths of the n-grams.
BITS, LENGTHS = 16, (1, 2, 3, 4)
#: Cost of a change of language between two words, in nats.
SWITCH = 12.0
#: A language counts as written in a script if at least this share of its letters is.
SCRIPT_SHARE = 0.01
WORD = re.compile(r"[^\W\d_]+")
#: First and last code points of the letters of common scripts.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
)
NAMES = [name for name, *_ in SCRIPTS] + ["other"]


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point."""
    found = np.full(len(points), len(SCRIPTS))
    for i, (_, first, last) in enumerate(SCRIPTS):
        found[(points >= first) & (points <= last)] = i
    return found


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the n-grams of all words, ends marked; the word number of each; the script of each word."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(words)), sizes)
    places, owners, h = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in LENGTHS and len(h):
            whole = owner[: len(h)] == owner[n - 1 :]
            places.append(((mix(h) >> np.uint64(64 - BITS))[whole]).astype(np.int64))
            owners.append(owner[: len(h)][whole])
    scripts = scripts_of(points[np.cumsum(sizes) - sizes + 1])
    return np.concatenate(places), np.concatenate(owners), scripts


def words_of(text: str) -> list[str]:
    """Lower-case words of a whole text, letters composed; a word has a letter, so signs like one half alone are none."""
    if text.isascii():
        return WORD.findall(text.lower())
    return [w for w in WORD.findall(unicodedata.normalize("NFC", text).lower()) if w.isalpha() or any(map(str.isalpha, w))]


@dataclass
class LanguageModel:
    """Log-probabilities of n-grams (languages x places) and the scripts of each language."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Mean log-probability of the n-grams of each word times its length (words x languages), the best at 0."""
        places, owner, script = grams(words)
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        length = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 12)
        found = np.stack([np.bincount(owner, row[places], len(words)) / n * length for row in self.table], axis=1)
        allowed = self.scripts[:, script].T
        found = np.where(allowed | ~allowed.any(axis=1, keepdims=True), found, found.min(axis=1, keepdims=True) - 30.0)
        return (found - found.max(axis=1, keepdims=True)).astype(np.float32)

    def label(self, texts: list[list[str]], switch: float = SWITCH) -> list[np.ndarray]:
        """Language numbers of the words of each text: the best path, by Viterbi over all texts at once.

        Texts go side by side, the longest first; step ``t`` handles the texts that
        have a word ``t``.
        """
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        order = [i for i in order if texts[i]]
        if not order:
            return [np.zeros(0, np.int16) for _ in texts]
        lengths = np.array([len(texts[i]) for i in order])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
        first = np.concatenate([[0], np.cumsum(active)])
        number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
        score = self.scores(list(number))
        flat = np.empty((first[-1], len(self.langs)), np.float32)
        for row, i in enumerate(order):
            n = len(texts[i])
            flat[first[:n] + row] = score[np.fromiter(map(number.__getitem__, texts[i]), np.int64, n)]
        back = np.empty(flat.shape, np.int16)
        best = flat[: active[0]].copy()
        numbers = np.arange(len(self.langs), dtype=np.int16)
        for t in range(1, lengths[0]):
            best = best[: active[t]]
            top = best.argmax(axis=1)
            jump = best[np.arange(len(best)), top][:, None] - switch
            stay = best >= jump
            back[first[t] : first[t + 1]] = np.where(stay, numbers, top[:, None])
            best = np.where(stay, best, jump) + flat[first[t] : first[t + 1]]
            flat[first[t] : first[t + 1]] = best
        out = [np.zeros(0, np.int16) for _ in texts]
        state = np.zeros(len(order), np.int16)
        path = np.empty(first[-1], np.int16)
        for t in range(lengths[0] - 1, -1, -1):
            n, ended = active[t], active[t + 1] if t + 1 < lengths[0] else 0
            state[ended:n] = flat[first[t] + ended : first[t + 1]].argmax(axis=1)
            path[first[t] : first[t + 1]] = state[:n]
            if t:
                state[:n] = back[first[t] : first[t + 1]][np.arange(n), state[:n]]
        for row, i in enumerate(order):
            out[i] = path[first[: len(texts[i])] + row]
        return out


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, place, n) over all rows with a language; places from ``2 ** BITS`` on count letters by script.

    A task keeps one array per language, so it sends a bounded number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = {}

        def settle() -> None:
            for lang, words in seen.items():
                counts = held.setdefault(lang, np.zeros((1 << BITS) + len(NAMES), np.int64))
                names, times = list(words), np.fromiter(words.values(), np.float64, len(words))
                if names:
                    places, owner, script = grams(names)
                    counts[: 1 << BITS] += np.bincount(places, times[owner], 1 << BITS).astype(np.int64)
                    counts[1 << BITS :] += np.bincount(script, times * np.fromiter(map(len, names), np.int64, len(names)), len(NAMES)).astype(np.int64)
            seen.clear()

        for batch in small(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > 200_000:
                settle()
        settle()
        for lang, counts in held.items():
            places = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(places), "place": places.astype(np.int32), "n": counts[places]})

    rows = docs.select(text_or_empty(docs[text_col]).alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn the languages of ``docs``; rows without a language are left out.

    Null texts have no words; repeated rows count as often as they come. An empty
    table gives a model without languages. The result has at most ``2 ** BITS`` and a few numbers per language.
    """
    found = count_grams(docs, text_col, lang_col).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), (1 << BITS) + len(NAMES)))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64), found["place"].to_numpy()] = found["n"].to_numpy()
    n = counts[:, : 1 << BITS] + 0.5
    letters = counts[:, 1 << BITS :]
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return LanguageModel(langs, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32), share >= SCRIPT_SHARE)


def spans_of(words: list[str], path: np.ndarray, langs: list[str]) -> list[tuple[str, int, int]]:
    """(language, first word, end word) of each run of the path."""
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)] if len(path) else [0]
    return [(langs[path[a]], a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """The language of each whole text.

    ``und`` with score 0 if the text is null, empty or has no letter, or if nothing
    was learned. The score is the share of letters in words labelled with the
    predicted language; ties go to the language first in order. Repeated rows are
    labelled alike. Other columns are ignored. An empty table gives no rows.

    Returns doc_id, lang_pred, score, spans (language, first and end word).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 500):
                words = [words_of(t) if model.langs else [] for t in texts[a : a + 500]]
                preds, scores, spans = [], [], []
                for own, path in zip(words, model.label(words, switch), strict=True):
                    letters = np.bincount(path, [len(w) for w in own], len(model.langs)) if own else np.zeros(1)
                    top = int(letters.argmax())
                    preds.append(model.langs[top] if own else "und")
                    scores.append(float(letters[top] / letters.sum()) if own else 0.0)
                    spans.append([{"lang": x, "first": i, "end": j} for x, i, j in spans_of(own, path, model.langs)])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 500), pa.array(preds), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first: int, end: int>>")


def held_out(doc_id):  # noqa: ANN001, ANN201
    """Whether a document is kept from training: crc32 of its id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(docs["doc_id"])))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))

"""Secret scans: fixed patterns, and character Markov models for what they miss.

The base patterns find assignments of passwords and tokens, access keys and long
hex strings. Beside them, two first-order Markov models over characters, one of
random strings and one of ordinary identifiers, are trained from labelled samples
by counting transitions; a candidate token is reported when the log-likelihood
ratio of its characters says random. Everything runs on built-in functions: match
places come from the lengths of the pieces between matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumera.llm.common import each, read_table, stored, text_or_empty, unused

#: The base patterns in their order, the group whose length counts, the least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Candidates of the models: runs of 16 or more token characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = [name for name, *_ in BASE] + ["markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The labelled sample: documents whose words serve as identifiers, and random strings made.
SAMPLE_DOCS, SAMPLE_RANDOM = 400, 4_000
#: A candidate is random if its log-likelihood ratio reaches this, in nats.
THRESHOLD = 12.0


def sample_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Different texts (t) of least hash, about ``SAMPLE_DOCS`` rows' worth, without what the base patterns match.

    The hash is the text's, so neither ids nor the layout of files matter, and a text
    that many rows repeat is one.
    """
    text = text_or_empty(docs[text_col])
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    chosen = docs.select(text.alias("t")).where(F.pmod(F.xxhash64(text, F.lit(1)), F.lit(1 << 31)) < share * (1 << 31)).distinct()
    for _, pattern, *_ in BASE:
        chosen = chosen.select(F.regexp_replace("t", pattern, " ").alias("t"))
    return chosen


def default_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled samples: (sample, is_random).

    Random: digests written in hex, in base 64 and in capitals with digits.
    Ordinary: words of the documents of :func:`sample_texts`, alone, in capitals, joined
    as identifiers are, numbers and dates, runs of the alphabet, as placeholders have, and rules of one sign.
    """
    spark = docs.sparkSession
    seed = spark.range(SAMPLE_RANDOM).select(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256).alias("s"), "id")
    base64 = F.base64(F.unhex("s"))
    strong = seed.select(
        F.explode(
            F.array(
                F.substr("s", F.lit(1), F.lit(40)),
                F.regexp_replace(base64, "=", ""),
                F.substr(F.regexp_replace(F.upper(base64), "[+/=]", ""), F.lit(1), F.lit(20)),
            )
        ).alias("sample"),
        F.lit(True).alias("is_random"),
    )
    words = sample_texts(docs, text_col).select(F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w"))
    ordinary = words.select(
        F.explode(
            F.array(
                F.col("w"),
                F.upper("w"),
                F.concat(F.upper("w"), F.lit("_"), F.upper("w")),
                F.concat(F.lower("w"), F.lit("_"), F.lower(F.reverse("w"))),
                F.concat("w", F.lit("-"), F.pmod(F.hash("w"), F.lit(1000)).cast("string")),
                F.concat(F.initcap("w"), F.initcap(F.lower("w")), F.pmod(F.hash("w"), F.lit(10)).cast("string")),
                F.concat(F.lit("/"), F.lower("w"), F.lit("/"), F.lower("w")),
            )
        ).alias("sample"),
        F.lit(False).alias("is_random"),
    )
    numbers = spark.range(SAMPLE_RANDOM).select(
        F.explode(
            F.array(
                F.abs(F.xxhash64("id")).cast("string"),
                F.date_format(F.timestamp_seconds(F.col("id") * 1_000_003), "yyyy-MM-dd_HH-mm-ss"),
            )
        ).alias("sample"),
        F.lit(False).alias("is_random"),
    )
    letters = F.lit(ALPHABET[26:52])
    runs = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(letters, F.upper(letters), *[F.lit(c * 20) for c in "+/_=-"])).alias("sample"), F.lit(False).alias("is_random"))
    return strong.unionByName(ordinary).unionByName(numbers).unionByName(runs)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random against ordinary.

    A pair (a, b) is at ``index(a) * (len(ALPHABET) + 1) + index(b)``, index 0 being
    any other character. Transition counts are summed by Spark; the driver gets at
    most one row per pair and label.
    """
    width = len(ALPHABET) + 1
    chars = F.split("sample", "")
    pairs = samples.where(F.length("sample") > 1).select(
        "is_random",
        F.explode(F.arrays_zip(F.slice(chars, F.lit(1), F.length("sample") - 1).alias("a"), F.slice(chars, F.lit(2), F.length("sample") - 1).alias("b"))).alias("p"),
    )
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    counts = pairs.groupBy("is_random", place(F.col("p.a")).alias("i"), place(F.col("p.b")).alias("j")).count().collect()
    n = {True: [[1.0] * width for _ in range(width)], False: [[1.0] * width for _ in range(width)]}
    for r in counts:
        n[r.is_random][r.i][r.j] += r["count"]
    table = []
    for i in range(width):
        rows = {k: sum(v[i]) for k, v in n.items()}
        table += [math.log(n[True][i][j] / rows[True]) - math.log(n[False][i][j] / rows[False]) for j in range(width)]
    return table


def likelihood_ratio(token: Column, table: list[float]) -> Column:
    """Sum of the pair ratios along a token."""
    ratios = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    chars = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    step = lambda sum_, i: sum_ + F.coalesce(F.get(ratios, F.get(chars, i - 1) * (len(ALPHABET) + 1) + F.get(chars, i)), F.lit(0.0))
    return F.when(F.length(token) < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), step))


def find_secrets(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The secrets of each document.

    Null and empty texts have none. Every row is a document of its own, so repeated
    rows give repeated results. Base matches never overlap within a kind; a match
    whose counted group is too short is dropped after it has been consumed. Spans of
    the models never overlap base spans. Positions are code points, end exclusive.
    Other columns are ignored. An empty table gives no rows.

    Returns doc_id, row_no, text_key (a hash of the text), spans: array of (start, kind number, end, kind, log-likelihood
    ratio of spans of the models), by start.
    """
    patterns = [p for _, p, *_ in BASE] + [CANDIDATE]
    text = F.col("text")
    rows = docs.select(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.xxhash64(text_or_empty(docs[text_col])).alias("text_key"), text_or_empty(docs[text_col]).alias("text"))
    matched = rows.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(patterns)])
    rows = stored(
        matched.select(
            "doc_id",
            "row_no",
            "text_key",
            F.filter(
                F.array(
                    *[
                        F.struct(
                            F.lit(k).alias("kind"),
                            F.col(f"m{k}").alias("matches"),
                            F.when(F.size(f"m{k}") > 0, F.transform(F.split(text, p, -1), F.length)).alias("before"),
                        )
                        for k, p in enumerate(patterns)
                    ]
                ),
                lambda x: F.size(x["matches"]) > 0,
            ).alias("found"),
        ),
        "matches",
    )
    each = rows.select("row_no", F.explode("found").alias("f")).select(
        "row_no", F.col("f.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("f.matches").alias("match"), F.slice("f.before", F.lit(1), F.size("f.matches")).alias("before")))
    )
    ends = Window.partitionBy("row_no", "kind").orderBy("pos")
    placed = each.select("row_no", "kind", F.col("col.match").alias("match"), F.sum(F.col("col.before") + F.length("col.match")).over(ends).alias("end"))
    counted = F.length("match")
    for k, (_, pattern, group, _) in enumerate(BASE):
        if group:
            counted = F.when(F.col("kind") == k, F.length(F.regexp_extract("match", pattern, group))).otherwise(counted)
    least = F.get(F.array(*[F.lit(n) for *_, n in BASE], F.lit(16)), F.col("kind"))
    judged = placed.where(counted >= least).withColumn("ratio", F.when(F.col("kind") == len(BASE), likelihood_ratio(F.col("match"), table)))
    good = judged.where(F.coalesce("ratio", F.lit(threshold)) >= threshold).select("row_no", "kind", "end", (F.col("end") - F.length("match")).alias("start"), "ratio")
    span = F.struct("start", "kind", "end", F.get(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("name"), "ratio")
    # A span of the models goes if a base span that begins no later ends behind its start, or the next one begins before its end.
    is_base, line = F.col("kind") < len(BASE), Window.partitionBy("row_no").orderBy("start")
    reach = F.max(F.when(is_base, F.col("end"))).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(is_base, F.col("start"))).over(line.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    clear = good.select("*", reach.alias("reach"), following.alias("following"))
    clear = clear.where(is_base | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("following", F.col("end")) >= F.col("end"))))
    spans = clear.groupBy("row_no").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return rows.select("doc_id", "row_no", "text_key").join(spans, "row_no", "left").select("doc_id", "row_no", "text_key", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans become one.

    ``found`` is what :func:`find_secrets` gives for the same ids and texts. A row is
    matched by its id and text, so ids may be null or repeat, with equal or different
    texts: each row comes out once, masked by its own spans. Null texts and rows that
    ``found`` doesn't have stay as they are. An empty table gives no rows.
    """
    id_, at, key = (unused(docs.columns, name) for name in ("_found_id", "_found_spans", "_found_key"))
    wanted = found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    wanted = wanted.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("spans").alias(at))
    named = docs.join(wanted, docs[id_col].eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty(docs[text_col])) == F.col(key)), "left")
    text, spans = docs[text_col], F.col(at)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda s, x: F.struct(
        F.when(x["end"] <= s["at"], s["out"])
        .otherwise(F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int")), F.when(x["start"] < s["at"], "").otherwise(mask)))
        .alias("out"),
        F.greatest(s["at"], x["end"]).cast("long").alias("at"),
    )
    whole = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), F.length(text))))
    masked = F.when(F.size(spans) > 0, whole).otherwise(text)
    return named.select(*[(masked.alias(c) if c == text_col else kept) for c, kept in zip(docs.columns, each(docs, docs.columns), strict=True)])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, with the models trained from the default samples."""
    docs = read_table(spark, sf_dir, "documents")
    found = find_secrets(docs, train(default_samples(docs)))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

"""Mixing sources to target weights by entropy balancing.

Each source gets a token target. Entropy balancing looks for document rates
``r_i`` that meet the token constraints and stay as close as possible (in
token-weighted relative entropy) to their prior rates ``q_i``; the solution is the
exponential tilt ``r_i = min(cap, q_i exp(lambda_s))``. The convex dual is solved
by Newton iterations: each is one distributed aggregate of tokens and their
derivative per source. As documents with one source and prior share a rate, the
iterations run over the token sums of these cells, not over the documents. Prior
rates go by length unless a column gives them, so that a source has several cells
of which some meet the cap before others.

Rates become whole copies by error diffusion: within a bounded chunk of a source,
documents go from the longest to the shortest and the unspent words are carried
on, so the short ones settle what the long ones leave.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumera.llm.common import HOT_KEY, HOT_KEYS, SPACE, each, numbered, read_table, stored, text_or_empty, unused

#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (3.0, 1.0, 2.0)
#: Up to so many sources their table is broadcast.
BROADCAST_SOURCES = 10_000
#: Words from which on a document is no longer very short, and from which on it is very long.
SHORT, LONG = 32, 4_096


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words to take from each source.

    ``share`` of all words is dealt by weight; a source stops at ``cap`` times its
    size and what it can't take is dealt again among the others.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= cap * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    return target


def entropy_balance(cells: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-9) -> dict[str, float]:
    """The dual variable of each source, by Newton's method, repeated until every source's words are met.

    ``cells``: source_key, prior (above 0), tokens. ``targets``: source_key, target. Every
    round aggregates the tokens taken at the present rates and their derivative
    with respect to the dual variable, which for disjoint sources is diagonal. It starts
    from the tilt that would do without the cap, which takes too little if anything; from
    there on the solution is held between two tilts, and every third step halves their
    distance, so the rounds end. A source that can't be met (its target is beyond ``cap``
    times its tokens) has every cell at the cap; one without tokens or target has 0 or
    -infinity. Repeated cells count together; sources without a target are ignored. Empty
    tables give no sources.
    """
    spark = cells.sparkSession
    start = cells.groupBy("source_key").agg(F.sum(F.col("prior") * F.col("tokens")).alias("mass"), F.sum("tokens").alias("tokens"), F.min("prior").alias("least"))
    known = targets.join(start, "source_key", "left").collect()
    dual, low, high, wanted = {}, {}, {}, {}
    for r in known:
        s, wanted[r.source_key] = r.source_key, r.target
        if not r.mass or not r.target > 0:
            dual[s] = 0.0 if not r.mass else -math.inf
            continue
        # At ``high`` every cell is at the cap.
        low[s], high[s] = math.log(r.target) - math.log(r.mass), math.log(cap) - math.log(r.least)
        dual[s] = high[s] if r.target >= cap * r.tokens else low[s]
    open_, rounds = {s for s in low if dual[s] < high[s]}, 0
    while open_:
        rounds += 1
        now = spark.createDataFrame([(s, dual[s]) for s in sorted(open_)], "source_key string, dual double")
        rate = F.exp(F.ln("prior") + F.col("dual"))
        sums = (
            cells.join(now, "source_key")
            .groupBy("source_key")
            .agg(
                F.sum(F.col("tokens") * F.least(F.lit(cap), rate)).alias("taken"),
                F.sum(F.when(rate < cap, F.col("tokens") * rate).otherwise(0.0)).alias("slope"),
            )
            .collect()
        )
        for r in sums:
            s, gap = r.source_key, wanted[r.source_key] - r.taken
            low[s], high[s] = (dual[s], high[s]) if gap > 0 else (low[s], dual[s])
            middle = (low[s] + high[s]) / 2
            if abs(gap) <= tolerance * max(1.0, wanted[s]) or not low[s] < middle < high[s]:
                open_.discard(s)  # met, as closely as doubles can
                continue
            step = dual[s] + gap / r.slope if r.slope and rounds % 3 else middle
            # What is taken rises with the dual variable, so a step out of what is known of it is halved.
            dual[s] = step if low[s] < step < high[s] else middle
    return dual


def length_prior(size: Column) -> Column:
    """Prior rate by length class: very short and very long documents are wanted less than others."""
    return F.when(size < SHORT, 0.5).when(size >= LONG, 0.75).otherwise(1.0)


def _copies(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of one chunk of a source by error diffusion, longest documents first.

    A row stands for ``times`` equal documents: ``whole`` copies of each, and one more
    of the first ``extra`` of them.
    """
    pdf = pdf.sort_values(["size", "doc_id", "text_key", "prior"], ascending=[False, True, True, True], kind="stable")
    rate, times = pdf["rate"].to_numpy(), pdf["times"].to_numpy()
    whole = np.floor(rate + 1e-9)
    part = np.maximum(rate - whole, 0.0)
    extra, carry = np.zeros(len(pdf), dtype=np.int64), 0.0
    for i, (n, p, k) in enumerate(zip(pdf["size"].tolist(), part.tolist(), times.tolist(), strict=True)):
        if n and p > 1e-9:
            carry += n * p * k
            extra[i] = min(k, max(0, math.floor(carry / n + 0.5)))
            carry -= n * extra[i]
    return pdf.assign(whole=whole.astype(np.int64), extra=extra)


def source_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    prior_col: str | None = None,
    weights=WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    chunk: int = 5_000,
    row_col: str | None = None,
) -> DataFrame:
    """Copies of each document so that every source comes near its token target.

    Sizes are counts of words; null texts have none. The null source is a source
    of its own, last in order. Documents without words and sources without words
    get rate 0 of nothing: taken is 0. Rows that repeat are documents of their own.
    Other columns are ignored. An empty table gives no rows. One row per source is
    held by the driver. ``prior_col`` gives prior rates, else :func:`length_prior` does.

    What is taken depends on the rows alone, not on how they are partitioned: equal
    rows (id, text, source, prior) are one unit with a count, units are dealt into
    chunks of about ``chunk`` by a hash of id and text, and ordered by size, id and
    text. Null ids are ids like any other. A source with most of the rows is thus
    split over many tasks, and a row that comes a billion times is one unit.
    ``row_col``: a column that numbers the rows, if there is one.

    Returns doc_id, source, size, source_size, target, rate, copies, taken, row_no.
    """
    spark = docs.sparkSession
    source = docs[source_col].cast("string")
    text = text_or_empty(docs[text_col])
    sized = docs.select(
        docs[id_col].alias("doc_id"),
        source.alias("source"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("source_key"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
        F.xxhash64(text).alias("text_key"),
        (F.lit(None).cast("double") if prior_col is None else F.greatest(F.lit(1e-9), F.coalesce(docs[prior_col].cast("double"), F.lit(1.0)))).alias("prior"),
        (F.monotonically_increasing_id() if row_col is None else docs[row_col]).alias("row_no"),
        F.spark_partition_id().alias("block"),
    )
    sized = stored(sized.withColumn("prior", F.coalesce("prior", length_prior(F.col("size")))), "sizes")
    unit = ["source_key", "doc_id", "text_key", "size", "prior"]
    units = stored(sized.groupBy(*unit).agg(F.count(F.lit(1)).alias("times")), "units")
    found = sized.groupBy("source", "source_key").agg(F.sum("size").alias("size")).collect()
    dealt = {r.source_key: r.n for r in units.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = source_targets({r.source: r["size"] for r in found}, weights, share, cap)
    kind = "source_key string, source_size long, target double, parts long"
    about = [(r.source_key, r["size"], float(target[r.source]), math.ceil(dealt[r.source_key] / chunk)) for r in found]
    sources = spark.createDataFrame(about, kind)
    cells = stored(units.groupBy("source_key", "prior").agg(F.sum(F.col("size") * F.col("times")).cast("double").alias("tokens")), "cells")
    dual = entropy_balance(cells, sources.select("source_key", "target"), cap)
    tilts = spark.createDataFrame([(*a, dual[a[0]]) for a in about], kind + ", dual double")
    # The driver has listed the sources one by one; beyond this number they are joined by a shuffle.
    tilts = F.broadcast(tilts) if len(about) <= BROADCAST_SOURCES else tilts
    rated = units.join(tilts, "source_key").select(
        *unit, "times", "source_size", "target",
        F.round(F.least(F.lit(cap), F.exp(F.ln("prior") + F.col("dual"))), 9).alias("rate"),
        F.pmod(F.xxhash64("doc_id", "text_key"), F.col("parts")).alias("part"),
    )
    out = T.StructType([*rated.schema.fields, T.StructField("whole", T.LongType()), T.StructField("extra", T.LongType())])
    chosen = stored(rated.groupBy("source_key", "part").applyInPandas(_copies, out), "chosen")
    same = [sized[c].eqNullSafe(chosen[c]) for c in unit]
    of_row = [sized[c] for c in ("doc_id", "source", "size", "row_no")]
    of_unit = [chosen[c] for c in ("source_size", "target", "rate")]
    # Rows that come once, most often all of them, take what their unit takes.
    once = sized.join(chosen.where("times = 1"), same).select(*of_row, *of_unit, (F.col("whole") + F.col("extra")).alias("copies"))
    every = once.unionByName(_dealt_among_equals(sized, chosen, same, of_row, of_unit, unit))
    return every.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_no")


def _dealt_among_equals(sized: DataFrame, chosen: DataFrame, same: list[Column], of_row: list[Column], of_unit: list[Column], unit: list[str]) -> DataFrame:
    """Rows of the units with several rows, the first ``extra`` of each with one copy more.

    Rows are counted by unit and block (a task's rows), and numbered within it, so the
    rows of a very frequent unit are never brought together. Units that come more
    than ``HOT_KEY`` times and make more than one part in ``HOT_KEYS`` of the rows are broadcast.
    """
    limit = max(HOT_KEY, sized.count() // HOT_KEYS)
    several = chosen.where("times > 1").withColumn("unit_no", F.monotonically_increasing_id())
    several = stored(several, "several")
    same = [sized[c].eqNullSafe(several[c]) for c in unit]
    of_unit = [several[c] for c in ("source_size", "target", "rate", "whole", "extra", "unit_no")]
    few = several.where(F.col("times") > limit)
    rows = sized.join(several.where(F.col("times") <= limit), same).select(*of_row, sized["block"], *of_unit)
    if not few.isEmpty():
        rows = rows.unionByName(sized.join(F.broadcast(few), same).select(*of_row, sized["block"], *of_unit))
    rows = stored(rows, "equals")
    before = F.sum("held").over(Window.partitionBy("unit_no").orderBy("block")) - F.col("held")
    blocks = rows.groupBy("unit_no", "block").agg(F.count(F.lit(1)).alias("held")).select("unit_no", "block", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("unit_no", "block").orderBy("row_no"))
    numbered_ = rows.withColumn("nth", nth).join(blocks, ["unit_no", "block"])
    more = (F.col("before") + F.col("nth") <= F.col("extra")).cast("long")
    return numbered_.select("doc_id", "source", "size", "row_no", "source_size", "target", "rate", (F.col("whole") + more).alias("copies"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150 % of their words."""
    return source_mix(read_table(spark, sf_dir, "documents")).drop("row_no")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix: each row as often as :func:`source_mix` takes it, whatever its id.

    Documents without words aren't taken. An empty table gives no rows.
    """
    rows, row = numbered(docs)
    copies = unused([*docs.columns, row], "_copies")
    times = source_mix(rows, id_col, text_col, source_col, row_col=row).where("copies > 0").select(F.col("row_no").alias(row), F.col("copies").cast("int").alias(copies))
    taken = rows.join(times, row)
    return taken.select(*each(taken, docs.columns), F.explode(F.array_repeat(F.lit(1), F.col(copies))).alias(copies)).drop(copies)

"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition becomes one run: its digests in sorted order, one entry
per text with the best row so far and a count. Runs are then merged in rounds,
``fan_in`` neighbours at a time (2 gives the binomial exchange), until one run
is left; within a round the merge is spread over all tasks by digest, so no task
ever holds a run as a whole. An entry is keyed by the SHA-256 of the normalised
text and verified by a second digest of another family and by the byte length.
Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.llm.common import SPACE, each, numbered, read_table, stored, text_or_empty

KEY = ["text_sha256", "check_hash", "norm_bytes"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One narrow row per document: digests of the normalised text, its length, its run."""
    row_no = F.monotonically_increasing_id() if row_col is None else docs[row_col]
    text = text_or_empty(docs[text_col])
    return docs.select(
        docs[id_col].alias("doc_id"),
        row_no.alias("row_no"),
        F.char_length(text).alias("n_chars"),
        F.regexp_replace(text, f"[{SPACE}]+", "").alias("_norm"),
    ).select(
        "doc_id",
        "n_chars",
        F.sha2("_norm", 256).alias("text_sha256"),
        F.xxhash64("_norm").alias("check_hash"),
        F.octet_length("_norm").alias("norm_bytes"),
        F.spark_partition_id().alias("run"),
        "row_no",
    )


def merge_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row per distinct text: ``best`` (the row that stays) and ``group_size``."""
    runs = rows.groupBy(*KEY, "run").agg(
        F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy(*KEY, "run")
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
        left = -(-left // fan_in)
    return runs.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, row_col: str | None = None) -> DataFrame:
    """Group documents of equal text and choose the one that stays.

    Texts are equal when they agree after white space is deleted; null counts as
    empty, so null, empty and blank texts form one group. The row with the most
    code points stays, then the one with the smallest id (null ids last), then
    the first in input order, so of repeated rows exactly one is kept. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    ``row_col``: a column that numbers the rows, if there is one.

    Returns doc_id, keep_id, group_size, kept, text_sha256, n_chars, row_no.
    """
    rows = stored(digests(docs, id_col, text_col, row_col), "digests")
    merged = merge_runs(rows, fan_in)
    return rows.join(merged, KEY).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        "text_sha256",
        F.col("n_chars").cast("long").alias("n_chars"),
        "row_no",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, one of each text, with all their columns.

    Null, empty and blank texts are one text. Decisions go by row, so null and
    repeated ids are no matter. An empty table gives no rows.
    """
    rows, row = numbered(docs)
    gone = exact_dedup(rows, id_col, text_col, row_col=row).where("NOT kept").select(F.col("row_no").alias(row))
    return rows.join(gone, row, "left_anti").select(*each(rows, docs.columns))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication of all documents."""
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("row_no", "n_chars")


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

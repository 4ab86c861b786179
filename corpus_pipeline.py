"""A corpus pipeline: reject toxic documents, drop copies, mix the sources, pack the rest.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame; all but the last return the columns of ``docs``. The last one
returns pieces of documents with their places in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumera.llm import exact_dedup, ngram_join, packing, source_mix, tokens, toxicity
from lumera.llm.common import read_table, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model, fitted on the labelled rows, rejects."""
    labels = toxicity.graded_labels(read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return exact_dedup.drop_exact_copies(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_join.drop_near_copies(docs)


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of the sources takes it."""
    return source_mix.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokens.default_tokenizer())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("source_mix", source_mix_stage),
    ("packing", packing_stage),
]

#: The toxicity model, shingle hashes and the packing search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over ``documents``, each result written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

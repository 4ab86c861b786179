"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.session import scratch_path

#: White space in the sense of the text contracts: space and the controls 09 to 0D.
SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; ``lumera.session.clear_stored`` deletes what lies there."""
    return scratch_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def each(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns of ``df`` with these names, dots and all."""
    return [df["`" + n.replace("`", "``") + "`"] for n in names]


def parts_for(rows: int, share: int, spark: SparkSession) -> int:
    """Tasks for work that is bound by ``rows``, about ``share`` to a task; the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // share))


#: A key with more rows than this may be too much for one task.
HOT_KEY = 10_000
#: Keys that are broadcast at most; where more have over ``HOT_KEY`` rows, the limit is that share of all rows.
HOT_KEYS = 100_000


def hot_limit(rows: int) -> int:
    """Rows up to which a key goes to one task: fewer than ``HOT_KEYS`` keys can have more."""
    return max(HOT_KEY, rows // HOT_KEYS)


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``keyed``, both stored and narrow, where ``keyed`` has a row a key and the number ``n`` of its rows.

    Keys beyond :func:`hot_limit` would put too many rows into one task. There are fewer
    than ``HOT_KEYS`` of them, so their rows of ``keyed`` are broadcast and those of ``rows``
    stay where they are; all other keys are joined by a shuffle. At 10^12 rows a task gets
    at most 10^7 rows of a key.
    """
    limit = hot_limit(rows.count())
    hot = keyed.where(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(keyed, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(n) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column that names each row, the same at every reading; and the name of that column.

    Rows of Parquet files that are read as they stand are named by file and place in
    it, without a copy. Any other table is stored with row numbers.
    """
    taken, name = {c.lower() for c in docs.columns}, "_row"
    while taken & {name, f"{name}_file", f"{name}_at"}:
        name += "_"
    plan = docs._jdf.queryExecution().analyzed()
    kind = lambda x: x.getClass().getSimpleName()
    if "_metadata" in taken or kind(plan) != "LogicalRelation" or kind(plan.relation()) != "HadoopFsRelation" or kind(plan.relation().fileFormat()) != "ParquetFileFormat":
        return stored(docs.select("*", F.monotonically_increasing_id().alias(name)), "numbered"), name
    placed = docs.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_at"))
    files = sorted(r[0] for r in placed.select(f"{name}_file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{name} long, {name}_file string")
    row = (F.shiftleft(name, 40) + F.col(f"{name}_at")).alias(name)
    return placed.join(F.broadcast(numbers), f"{name}_file").select(*each(docs, docs.columns), row), name


def text_or_empty(text: str | Column = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def trim() -> None:
    """Give freed memory of this Python worker back to the system, which it would keep for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that few texts are Python objects at a time."""
    try:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                yield batch.slice(a, rows)
    finally:
        trim()

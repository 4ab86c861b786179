"""Session defaults and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lumera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for.

    Settings that a cluster has already made win; ``conf`` adds to the defaults.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is ``spark.checkpoint.dir``. Only a local master may go without; it then
    gets a temporary folder, as there is one machine.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = "file://" + tempfile.mkdtemp(prefix="lumera-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def scratch_root(spark: SparkSession) -> str:
    """The folder in which this application stores intermediate tables."""
    return f"{shared_dir(spark)}/lumera-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def clear_stored(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; DataFrames that still read them no longer work.

    Call it when results have been written. Tables of other applications stay.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so what follows doesn't compute it anew."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""What the operators share: written intermediate tables and partition prefix sums."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a session in one JVM (``local[...]``) may leave it unset: a temporary
    folder is then made once and kept in the session's configuration.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark.conf.get("sheafwork.local.dir", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("sheafwork.local.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below :func:`shared_dir` and read it back: lineage ends here,
    so a lost executor costs a reread and not a recomputation.  Shuffle files
    of the write go as soon as it is done, for nothing needs them any more."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def partition_bases(totals: DataFrame, part: str, total: str) -> DataFrame:
    """Rows (part, base): the sum of ``total`` over smaller ``part`` values.

    ``totals`` has a row per partition of a written table, so the window holds
    as many rows as the write had tasks, whatever the data; with that bound
    they are broadcast, so that the table itself is not shuffled.
    """
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.groupBy(part).agg(F.sum(total).alias("_total"))
    return F.broadcast(sums.select(part, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("base")))

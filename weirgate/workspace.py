"""Shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: there the
    driver's disk is the executors' disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="weirgate-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    ``files`` gathers a result known to be small, so that iterative steps on it
    run few tasks.
    """
    spark = df.sparkSession
    path = scratch(spark, "stage")
    (df.repartition(files) if files else df).write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more. What else is passed stays as it is."""
    for table in tables:
        if path := table.__dict__.pop("_written_to", None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side stays under ``max_rows``.

    The count stops at the bound. Beyond it the plain frame is returned and the
    join is left to a shuffle with adaptive skew handling.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


HOT_KEYS, HOT_ROWS = 1_000, 5_000_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """Join ``left`` (about ``rows`` rows, any skew) to ``right``, which is unique on ``key``.

    A key that holds more than 1/1000 of ``left``, or more than ``HOT_ROWS`` rows, is hot; so few keys
    can be that their right rows are broadcast. All other keys are joined by
    a shuffle without a hot partition. ``left`` is read three times: pass a
    written table.
    """
    limit = min(max(rows // HOT_KEYS, 1_000), HOT_ROWS)
    counted = left.groupBy(key).count().filter(F.col("count") > limit).select(key)
    hot = F.broadcast(counted)
    hot_right = F.broadcast(right.join(hot, key, "left_semi"))
    return (
        left.join(hot, key, "left_semi").join(hot_right, key, how)
        .unionByName(left.join(hot, key, "left_anti").join(right, key, how))
    )

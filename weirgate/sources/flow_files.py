"""CSV and Parquet flow files: scans, append, archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirgate.functions.cleaning import NULL_TEXT, day_of
from weirgate.workspace import broadcast_if_small, cut_lineage

CSV_OPTIONS = {"header": True, "nullValue": NULL_TEXT, "sep": ","}


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, encoding: str = "UTF-8") -> DataFrame:
    """Flow CSV with an explicit schema; the ``NULL`` text is null and a UTF-8 mark is skipped."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, encoding=encoding).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=True, nullValue=NULL_TEXT).csv(path)


def non_utf8_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files (column ``file``) with a byte sequence that is not UTF-8, found line by line in parallel."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    return lines.filter(~F.col("ok")).select("file").distinct()


def read_csv_any_encoding(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """UTF-8 where the bytes allow it, Latin-1 for the other files.

    Latin-1 maps every byte, so no further encoding is ever reached. File names stay on the executors: each
    reading keeps the rows of its own files.
    """
    odd = cut_lineage(non_utf8_files(spark, path))
    plain = read_csv(spark, path, schema)
    if odd.isEmpty():
        return plain
    latin = read_csv(spark, path, schema, "ISO-8859-1")
    odd = broadcast_if_small(odd)
    return (
        plain.withColumn("file", F.col("_metadata.file_path")).join(odd, "file", "left_anti")
        .unionByName(latin.withColumn("file", F.col("_metadata.file_path")).join(odd, "file", "left_semi")).drop("file")
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise if there is nothing to train on or to score."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def create_if_absent(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty table with its schema, unless one is there."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_by_day(df: DataFrame, path: str) -> None:
    """Append flow rows to a table with one folder per day, so a time filter skips whole days.

    Days are whole days since the epoch, whatever a session's time zone.
    """
    df.withColumn("day", day_of(F.col("time_us"))).write.mode("append").partitionBy("day").parquet(path)


def archive(spark: SparkSession, live: str, archived: str, fresh: str, schema: StructType) -> DataFrame:
    """Move the rows of ``live`` to the archive and open an empty generation at ``fresh``.

    The archive keeps one folder per live generation and replaces that folder, so
    a job that is run again after a failure archives nothing twice.
    """
    name = live.rstrip("/").rsplit("/", 1)[-1]
    rows = spark.read.schema(schema).parquet(live)
    if not rows.isEmpty():
        rows.write.mode("overwrite").parquet(f"{archived}/generation={name}")
    create_if_absent(spark, fresh, schema)
    return spark.read.schema(schema).parquet(fresh)


def read_archive(spark: SparkSession, archived: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(archived).select(*schema.names)

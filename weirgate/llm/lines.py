"""Removal of repeated runs of lines by prefix doubling over line names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm import bloom
from weirgate.llm.repeats import with_ranges
from weirgate.workspace import cut_lineage

LEAST = 3
#: Bytes besides whitespace from which a repeated run of fewer lines counts too, down to a single line.
FLOOR = 16
BLANK = r"[\x20\x09-\x0D]+"


def _named(positions: DataFrame, by: list[str]) -> DataFrame:
    """Positions whose value in ``by`` occurs elsewhere too, named by the least position that has it."""
    classes = cut_lineage(positions.groupBy(*by).agg(F.min("pid").alias("_name"), F.count("*").alias("_n"))
                          .filter("_n > 1").drop("_n"))
    return cut_lineage(positions.join(classes, by).drop(*by).withColumnRenamed("_name", "name"))


def _later(named: DataFrame, size: int) -> DataFrame:
    """The runs of ``size`` lines that are not the first of their name."""
    first = cut_lineage(named.groupBy("name").agg(F.min(F.struct("_key", "line")).alias("_first")))
    later = named.join(first, "name").filter(F.struct("_key", "line") > F.col("_first"))
    return later.select("_row", F.col("line").cast("long").alias("start"), (F.col("line") + size).cast("long").alias("end"))


def repeated_runs(rows: DataFrame, least: int = LEAST, floor: int | None = None) -> DataFrame:
    """Runs of ``least`` lines (_row, start, end: line numbers, end exclusive) that an earlier run equals.

    With ``floor`` runs of fewer lines, too, that hold so many bytes besides whitespace; names then grow by one line a
    round, so that every length is seen.

    A run is earlier when its text has a smaller _key, or the same and it starts on an earlier line. Names of single lines
    are doubled: two names at growing offsets make the name of a longer run, equal runs get one name, and
    positions whose name is unique drop out of all later rounds. Runs reach ``least`` lines after about log2(least) rounds.
    """
    every = floor is not None
    bytes_of = [F.octet_length(F.regexp_replace("col", BLANK, "")).cast("long").alias(c) for c in ("own", "size")] if every else []
    lines = rows.withColumn("_id", F.monotonically_increasing_id()) \
        .select("_key", "_row", "_id", F.posexplode(F.split("text", "\n"))) \
        .select("_key", "_row", "_id", F.col("pos").alias("line"), F.monotonically_increasing_id().alias("pid"),
                F.xxhash64(F.lit(1), "col").alias("high"), F.xxhash64(F.lit(2), "col").alias("low"), *bytes_of)
    named, have = _named(cut_lineage(lines), ["high", "low"]), 1
    shorter = []
    while have < least:
        if every:
            shorter.append(_later(named.filter(F.col("size") >= floor), have))
        step = 1 if every else min(have, least - have)
        ahead = Window.partitionBy("_id").orderBy("line").rangeBetween(step, step)
        pairs = named.withColumn("next", F.first("name").over(ahead))
        if every:
            pairs = pairs.withColumn("size", F.col("own") + F.first("size").over(ahead))
        named, have = _named(pairs.filter("next IS NOT NULL"), ["name", "next"]), have + step
    return cut_lineage(reduce(DataFrame.unionByName, shorter, _later(named, least)).distinct())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, starts, ends in zip(*(batch.column(c) for c in ("text", "starts", "ends"))):
            lines = text.as_py().split("\n")
            gone = bytearray(len(lines))
            for low, high in zip(starts.values.to_pylist(), ends.values.to_pylist()):
                gone[low:high] = b"\1" * (high - low)
            kept = "\n".join(line for line, g in zip(lines, gone) if not g)
            runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
            out.append((len(lines), sum(gone), runs, kept))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("_key"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
            ["_key", "n_lines", "n_removed", "n_runs", "kept"])


def remove_line_runs(
    docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", floor: int | None = None,
) -> DataFrame:
    """Each text without the lines of runs of ``least`` or more lines that occur earlier; with ``floor`` also of
    shorter runs, down to one line, that hold so many bytes besides whitespace.

    Lines are split at line feeds and compared as they are, blank ones too. Overlapping runs make one maximal run; the first copy
    stays, later ones go, within a text as well. Returns per row ``key``, n_lines, n_removed, n_runs (maximal
    removed runs), kept (the text left). Null text is empty, which is one line; a null key is neither earlier nor later
    than any; rows that share a key and a line number do not remove from each other there, and rows repeated with key
    and text fare alike. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    whole = docs.select(F.col(key).alias("_key"), F.xxhash64(key, text).alias("_row"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = repeated_runs(whole.filter("_key IS NOT NULL"), least, floor)
    touched, plain = with_ranges(whole, ranges, bloom.shared(ranges.select("_row")))
    changed = touched.select("_key", "text", "starts", "ends").mapInArrow(
        _cut, f"_key {kind}, n_lines long, n_removed long, n_runs long, kept string")
    zero = F.lit(0).cast("long")
    same = plain.select("_key", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), zero.alias("n_removed"),
                        zero.alias("n_runs"), F.col("text").alias("kept"))
    return changed.unionByName(same).withColumnRenamed("_key", key)

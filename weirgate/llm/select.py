"""Ordered cuts and gapless numbers over groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.workspace import broadcast_if_small, cut_lineage

#: Rows of a group that one task may sort.
SORTED_ROWS = 100_000
KEY_BITS = 48
STEP = 16


def hash48(*columns: Column, seed: str = "") -> Column:
    """48 bits of the MD5 of the columns' texts, the same in every engine; nulls read as empty."""
    joined = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, KEY_BITS // 4), 16, 10).cast("long")


def take_in_order(rows: DataFrame, group: str, key: str, size: str, need: str, ties: list[str]) -> DataFrame:
    """Mark with ``chosen`` the rows that fill ``need`` units of their group in the order of ``key``.

    ``key`` is a long below 2**48, ``need`` is the same in all rows of a group. Rows
    are taken while they fit; the row that crosses ``need`` is taken when that
    comes nearer to it. Instead of sorting a group, its histogram over the leading
    bits of the key finds the stretch that holds the crossing, round by round, until a
    stretch is small; rows with equal keys are then ordered by ``ties``. ``rows``
    is read several times: pass a written table.
    """
    cut = rows.select(group, F.col(need).alias("_goal")).distinct().filter("_goal > 0") \
        .select(group, "_goal", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_spent"),
                F.lit(0).cast("long").alias("_rows"))
    cut, shift = cut_lineage(cut), KEY_BITS
    while shift:
        inside = rows.join(broadcast_if_small(cut), group).filter(F.shiftright(key, shift) == F.col("_prefix"))
        shift -= STEP
        parts = inside.groupBy(group, "_goal", "_spent", F.shiftright(key, shift).alias("_part")).agg(
            F.sum(size).cast("long").alias("_units"), F.count("*").alias("_rows"))
        seen = F.sum("_units").over(Window.partitionBy(group).orderBy("_part"))
        cut = cut_lineage(
            parts.withColumn("_seen", seen + F.col("_spent"))
            .filter((F.col("_seen") >= F.col("_goal")) & (F.col("_seen") - F.col("_units") < F.col("_goal")))
            .select(group, "_goal", F.col("_part").alias("_prefix"),
                    (F.col("_seen") - F.col("_units")).alias("_spent"), "_rows"))
        if (cut.agg(F.max("_rows")).first()[0] or 0) <= SORTED_ROWS:
            break
    placed = rows.join(broadcast_if_small(cut.drop("_goal", "_rows")), group, "left") \
        .withColumn("_part", F.shiftright(key, shift))
    crossing = placed.filter("_part = _prefix")
    order = Window.partitionBy(group).orderBy(key, *ties)
    before = F.col("_spent") + F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    crossing = crossing.withColumn("_before", before).withColumn("chosen", (
        (F.col("_before") + F.col(size) <= F.col(need))
        | ((F.col("_before") < F.col(need)) & (F.col(need) - F.col("_before") >= F.col(size) / 2))))
    others = placed.filter("_prefix IS NULL OR _part <> _prefix").withColumn(
        "chosen", (F.col(need) > 0) & F.coalesce(F.col("_part") < F.col("_prefix"), F.lit(True)))
    extra = ["_prefix", "_spent", "_part"]
    return others.drop(*extra).unionByName(crossing.drop("_before", *extra))


def number_in_order(rows: DataFrame, group: str, key: str, ties: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each group, in the order of ``key`` (a long below 2**48) and ``ties``.

    The key space is cut into as many equal parts as keep a part small; each part
    is sorted by itself and starts at the count of the parts before it. A part
    that is still too large, because equal keys cannot be cut, is dealt
    over its rows' addresses in the table and numbered in that order instead.
    ``rows`` must be a written table, whose rows have addresses.
    """
    total = rows.count()
    parts = max(1, 2 * total // SORTED_ROWS)
    part = F.floor(F.col(key).cast("double") / (1 << KEY_BITS) * parts).cast("long")
    placed = rows.withColumn("_part", part) \
        .withColumn("_file", F.col("_metadata.file_path")) \
        .withColumn("_block", F.floor(F.col("_metadata.row_index") / SORTED_ROWS))
    limit = max(SORTED_ROWS, total // 10_000)  # at most 10,000 parts hold more
    full = F.broadcast(placed.groupBy(group, "_part").count().filter(F.col("count") > limit)
                       .select(group, "_part", F.lit(True).alias("_full")))
    placed = placed.join(full, [group, "_part"], "left") \
        .withColumn("_file", F.when(F.col("_full"), F.col("_file")).otherwise("")) \
        .withColumn("_block", F.when(F.col("_full"), F.col("_block")).otherwise(F.lit(0)))
    place = [group, "_part", "_file", "_block"]
    counts = placed.groupBy(*place).count()
    above = Window.partitionBy(group).orderBy("_part", "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("count").over(above), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(key, *ties)) - 1
    return placed.withColumn("_rank", rank).join(starts, place) \
        .withColumn(name, F.col("_start") + F.col("_rank")) \
        .drop("_part", "_file", "_block", "_full", "_rank", "_start")

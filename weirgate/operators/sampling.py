"""Deterministic sampling: stratified cap, row cap, hold-out split, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.functions.hashing import order_key, uniform
from weirgate.workspace import broadcast_if_small

# Each histogram round looks at this many further hex digits of the key, so it
# shuffles at most 4096 counts per stratum and task. Two rounds narrow 10^12 rows
# to about 10^5, which are then ranked.
DIGITS = 3
RANK_ROWS = 100_000
KEY_DIGITS = 32


def smallest_keys(df: DataFrame, n: int, key: Column, by: str | None = None,
                  digits: int = DIGITS, rank_rows: int = RANK_ROWS) -> Column:
    """Condition that keeps the ``n`` smallest keys, per value of ``by`` if given.

    A histogram of the key's leading digits names the bucket in which the n-th
    key lies; while that bucket is large the next digits split it; then only it
    is ranked. The result is a row predicate, so sampling shuffles no rows and no
    class is sorted in one task, however large it is. Only one cut-off per
    stratum reaches the driver.
    """
    stratum = F.col(by) if by else F.lit(0)
    keyed = df.select(stratum.alias("s"), key.alias("key")).filter(F.col("s").isNotNull())
    run = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    inside, need, length = F.lit(True), F.lit(n), 0
    while True:
        length += digits
        bucket = F.substring("key", 1, length)
        histogram = keyed.filter(inside).groupBy("s", bucket.alias("b")).count()
        cuts = (
            histogram.withColumn("upto", F.sum("count").over(run)).withColumn("need", need)
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("count") < F.col("need")))
            .select("s", "b", "count", (F.col("need") - F.col("upto") + F.col("count")).alias("need"))
            .collect()
        )
        if not cuts:  # no stratum has more than n rows
            return stratum.isNotNull()
        inside = reduce(lambda a, b: a | b, [(F.col("s") == r["s"]) & (bucket == r["b"]) for r in cuts])
        need = F.create_map(*[F.lit(x) for r in cuts for x in (r["s"], r["need"])])[F.col("s")]
        if max(r["count"] for r in cuts) <= rank_rows or length + digits > KEY_DIGITS:
            break
    rank = F.row_number().over(Window.partitionBy("s").orderBy("key"))
    last = (
        keyed.filter(inside).withColumn("rank", rank).filter(F.col("rank") == need).select("s", "key").collect()
    )
    keep = F
    for r in last:
        keep = keep.when(stratum == r["s"], key <= r["key"])
    return keep.otherwise(stratum.isNotNull())


def stratified_cap(
    df: DataFrame, n: int = 2000, by: str = "label", id_col: str = "flow_id",
    seed: int = 42, **narrowing,
) -> DataFrame:
    """At most ``n`` rows per value of ``by``, without replacement; null strata drop out.

    ``by`` must have few distinct values, as class labels do.
    """
    return df.filter(smallest_keys(df, n, order_key(seed, F.col(id_col)), by, **narrowing))


def row_cap(
    df: DataFrame, n: int = 30_000, id_col: str = "flow_id", seed: int = 42, **narrowing,
) -> DataFrame:
    """At most ``n`` rows, without replacement."""
    return df.filter(smallest_keys(df, n, order_key(seed, F.col(id_col)), **narrowing))


def is_test(id_col: str = "flow_id", fraction: float = 0.3, seed: int = 42) -> Column:
    return uniform(f"{seed}:split", F.col(id_col)) < fraction


def split(
    df: DataFrame, fraction: float = 0.3, id_col: str = "flow_id", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, exhaustive, the same on any partitioning."""
    test = is_test(id_col, fraction, seed)
    return df.filter(~test), df.filter(test)


def fold(folds: int, id_col: str = "flow_id", seed: int = 42) -> Column:
    """Fold number from a hash alone: folds of nearly equal size, whatever the classes."""
    return F.floor(uniform(f"{seed}:fold", F.col(id_col)) * folds).cast("int")


def stratified_fold(df: DataFrame, folds: int, label: str = "label", id_col: str = "flow_id", seed: int = 42,
                    output: str = "fold", rank_rows: int = RANK_ROWS) -> DataFrame:
    """``df`` with a fold number: the class counts of any two folds differ by one at most.

    Rows of a class are numbered in the order of their keys, without gaps, and dealt in turn. A histogram of the keys'
    leading digits says how many rows of the class come before each bucket, and only buckets of about ``rank_rows`` rows
    are sorted, so no class is held in one task. Null labels are a class of their own; ids must be unique, or rows
    of one id may change places. A column named ``output`` is replaced.
    """
    rows = df.drop(output).withColumn("_key", order_key(f"{seed}:fold", F.col(id_col)))
    total, digits = rows.count(), 1
    while total > rank_rows * 16 ** digits:
        digits += 1
    rows = rows.withColumn("_bucket", F.substring("_key", 1, digits)).withColumn("_class", F.col(label))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_class", "_bucket").agg(F.count("*").alias("_n")).select(
        F.col("_class").alias("_c"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("_key")) - 1
    numbered = rows.withColumn("_place", place).join(
        broadcast_if_small(starts), F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    return numbered.withColumn(output, ((F.col("_start") + F.col("_place")) % folds).cast("int")) \
        .drop("_key", "_bucket", "_class", "_c", "_b", "_start", "_place")

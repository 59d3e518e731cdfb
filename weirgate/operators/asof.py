"""As-of lookup: the last fact at or before each probe, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.operators.evaluate import add_slice, slice_edges

SLICE_ROWS = 2_000_000


def asof_last(
    probes: DataFrame, facts: DataFrame, keys: list[str], value: str, output: str,
    time: str = "time_us", tie: str = "event_id", slice_rows: int = SLICE_ROWS,
    edges: list[float] | None = None, null_safe: bool = False,
) -> DataFrame:
    """``probes`` plus ``output``: the ``value`` of the latest fact with the same keys.

    Order is (time, tie), and a fact precedes a probe at the same point. A null
    key matches nothing, or with ``null_safe`` a null. Both
    sides are unioned and read by a running window, so no pairs are formed. When
    the rows exceed ``slice_rows`` the window runs per key and time slice; one
    summary row per key and slice carries the last value forward, so a key that
    holds a third of all rows is spread over all slices. ``edges`` reuses time
    slices already found.
    """
    payload = F.struct(*[F.col(c) for c in probes.columns])
    kind = probes.select(payload.alias("p")).schema["p"].dataType
    dtype = facts.schema[value].dataType
    known = [F.col(k) for k in keys]
    events = (facts if null_safe else facts.dropna(subset=keys)).select(
        *known, F.col(time).alias("t"), F.col(tie).alias("i"), F.lit(0).alias("side"),
        F.col(value).alias("v"), F.lit(None).cast(kind).alias("probe"),
    ).unionByName(probes.select(
        *known, F.col(time).alias("t"), F.col(tie).alias("i"), F.lit(1).alias("side"),
        F.lit(None).cast(dtype).alias("v"), payload.alias("probe"),
    ))
    if edges is None:
        edges = slice_edges(events.select("t"), "t", slice_rows)
    sliced = add_slice(events, "t", edges)
    upto = Window.partitionBy(*keys, "slice").orderBy("t", "i", "side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn("near", F.last("v", ignorenulls=True).over(upto)).filter("side = 1")

    if not edges:
        return local.select("probe.*", F.col("near").alias(output))

    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("t", "i")))
    carried = (
        sliced.groupBy(*keys, "slice").agg(newest.alias("v"))
        .withColumn("before", F.last("v", ignorenulls=True).over(earlier))
        .filter(F.col("before").isNotNull())
        .select(*keys, "slice", "before")
    )
    # Both sides are partitioned by key and slice, and the larger one already is.
    if null_safe:
        carried = carried.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "slice")], "before")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "slice")]
        return local.join(carried, same, "left").select("probe.*", F.coalesce("near", "before").alias(output))
    return local.join(carried, [*keys, "slice"], "left").select(
        "probe.*", F.coalesce("near", "before").alias(output))

"""Synthetic minority oversampling (Chawla et al. 2002) with hashed choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.functions.hashing import order_key, uniform
from weirgate.operators.neighbors import with_neighbors
from weirgate.operators.sampling import smallest_keys
from weirgate.workspace import cut_lineage, join_hot

ENDS_BROADCAST_ROWS = 20_000
SYNTHETIC = "base_id bigint, neighbor_id bigint, copy int, label int, x array<double>, id bigint"


def smote(df: DataFrame, k: int = 5, id_col: str = "flow_id", label: str = "label", seed: int = 42,
          **search) -> DataFrame:
    """Synthetic rows that raise every smaller class to the size of the largest.

    Input holds (id, label, x). Each minority row serves as a base the same number
    of times; the remainder goes to the rows with the smallest hashes. Every copy
    picks one of its k neighbours and a point on the segment by hash.
    ``base_id``, ``neighbor_id`` and ``copy`` tell where a row came from; its
    ``id`` is negative and unique if the given ids are not negative. Equal classes
    give no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), "x").filter(F.col("label").isNotNull())
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    target = max(sizes.values(), default=0)
    out = None
    for cls in sorted(sizes):
        n, extra = sizes[cls], target - sizes[cls]
        if not extra:
            continue
        if n < k + 1:
            raise ValueError(f"class {cls} has {n} rows; {k + 1} are needed for {k} neighbours")
        made = _oversample(rows.filter(F.col("label") == cls), n, extra, k, seed, search)
        out = made if out is None else out.unionByName(made)
    if out is None:
        return df.sparkSession.createDataFrame([], SYNTHETIC)
    # No base has more copies than the smallest class needs.
    stride = target // min(sizes.values()) + 1
    return out.withColumn("id", -(F.col("base_id") * stride + F.col("copy")))


def _oversample(minority: DataFrame, n: int, extra: int, k: int, seed: int, search: dict) -> DataFrame:
    each, left = divmod(extra, n)
    copies = F.lit(each)
    if left:
        chosen = smallest_keys(minority, left, order_key(f"{seed}:base", F.col("id")))
        copies = copies + chosen.cast("int")
    bases = minority.withColumn("copies", copies).filter(F.col("copies") > 0)
    # One more neighbour than asked for, since a row is its own nearest.
    near = with_neighbors(bases, minority, k + 1, 2, **search)
    others = F.slice(F.filter("neighbors", lambda m: m["id"] != F.col("id")), 1, k)
    pick = F.floor(uniform(f"{seed}:neighbor", F.col("id"), F.col("copy")) * k).cast("int")
    gap = uniform(f"{seed}:gap", F.col("id"), F.col("copy"))
    planned = (
        near.select("id", "label", "x", others.alias("others"),
                    F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("id", "label", "x", "copy", gap.alias("gap"),
                F.element_at("others", pick + 1)["id"].alias("neighbor_id"))
    )
    ends = minority.select(F.col("id").alias("neighbor_id"), F.col("x").alias("end"))
    if n <= ENDS_BROADCAST_ROWS:
        paired = planned.join(F.broadcast(ends), "neighbor_id")
    else:
        # Among many equal points the lowest ids are everyone's neighbours.
        paired = join_hot(cut_lineage(planned), ends, "neighbor_id", extra)
    return paired.select(
        F.col("id").alias("base_id"), "neighbor_id", "copy", F.col("label").cast("int").alias("label"),
        F.zip_with("x", "end", lambda a, b: a + F.col("gap") * (b - a)).alias("x"),
    )


def balance(df: DataFrame, **options) -> DataFrame:
    """The labelled rows plus the synthetic ones, as (id, label, x)."""
    id_col = options.get("id_col", "flow_id")
    label = options.get("label", "label")
    real = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"), "x")
    return real.filter(F.col("label").isNotNull()).unionByName(smote(df, **options).select("id", "label", "x"))

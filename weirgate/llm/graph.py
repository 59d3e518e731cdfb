"""Connected components by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.workspace import cut_lineage, discard


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("_low"))


def _mark(edges: DataFrame) -> tuple:
    # sums of hashes as decimals: no overflow, independent of order
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Each linked node with the smallest node of its component, from undirected edges ``a``, ``b``.

    Returns node, component. Every round hangs the larger neighbours of a node on its
    smallest neighbour, then the smaller ones likewise, until nothing moves; the
    rounds needed grow with the logarithm of the longest path. A node's neighbours are
    only ever reduced to their least, never gathered. Loops and repeated edges are
    harmless; nodes without an edge to another are left out.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        low = cut_lineage(_lowest(both).withColumn("_low", F.least("a", "_low")))
        large = cut_lineage(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_low").alias("b")).distinct())
        discard(low, now)
        low = cut_lineage(_lowest(large))
        small = large.join(low, "a").filter("b <> _low").select(F.col("b").alias("a"), F.col("_low").alias("b")) \
            .union(low.select("a", F.col("_low").alias("b")))
        now = cut_lineage(small.distinct())
        discard(low, large)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())

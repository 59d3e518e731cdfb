"""Rendezvous hashing of record keys over weighted shards, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.select import KEY_BITS, hash48, number_in_order
from weirgate.workspace import cut_lineage

RECORD_BYTES = 16


def _score(key: Column, shard: int, weight: float) -> Column:
    """Exponential race: the shard with the least time wins, in proportion to its weight."""
    unit = (hash48(key, seed=f"shard{shard}") + F.lit(0.5)) / F.lit(float(1 << KEY_BITS))
    return -F.log(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float], known: Column | None = None) -> Column:
    """The shard of each key: key and weights decide, nothing else.

    A shard's time depends only on the key and that shard, so adding a shard
    moves rows only into it, and raising a weight moves rows only to that shard.
    Equal times go to the lower shard. A null key is hashed as empty.
    """
    runs = [F.struct(_score(key, i, w).alias("time"), F.lit(i).alias("shard"))
            for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*runs))["shard"]


def shard_rows(
    docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0,
) -> DataFrame:
    """All rows in ``len(weights)`` shards, with a gapless slot in each.

    Returns ``key``, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard,
    slot, grown_shard (the shard were there one more, of ``grown_weight``). Rows are numbered in the order
    of a hash of the key, so shards come out shuffled. Null text counts as empty, a
    null key as the empty one. Repeated keys share a shard and are numbered by
    size and checksum; a key that repeats too often to be sorted at once is
    numbered by row address. An empty table gives no rows; other columns are
    ignored.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    times = F.array(*[F.struct(_score(F.col("_key"), i, w).alias("time"), F.lit(i).alias("shard"))
                      for i, w in enumerate([*weights, grown_weight]) if w > 0])
    base = docs.select(F.col(key).alias("_key"), (F.octet_length(body).cast("long") + RECORD_BYTES).alias("size"),
                       F.crc32(body).alias("text_crc32")).withColumn("_times", times)
    own = F.array_min(F.slice("_times", 1, sum(w > 0 for w in weights)))
    rows = cut_lineage(base.select(
        "_key", "size", "text_crc32", own["shard"].alias("shard"),
        F.array_min("_times")["shard"].alias("grown_shard"), hash48(F.col("_key"), seed="slot").alias("_order")))
    numbered = number_in_order(rows, "shard", "_order", ["_key", "size", "text_crc32"], "slot")
    return numbered.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           F.col("slot").cast("long").alias("slot"), "grown_shard")

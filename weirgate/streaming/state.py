"""Streaming state with built-in aggregations: partial aggregates absorb hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirgate.functions.cleaning import drop_lldp
from weirgate.operators.state import HARD_SECONDS, IDLE_SECONDS, JOINS, LEAVES, MATCH, joined_bins, lifetime


def switch_registry(events: DataFrame, leaves: tuple[str, ...] = LEAVES) -> DataFrame:
    """Latest registering or unregistering state per switch, updated by every batch."""
    newest = F.max(F.struct("time_us", "event_id", "state"))
    return events.filter(F.col("state").isin(JOINS, *leaves)).groupBy("dpid").agg(newest.alias("newest")).select(
        "dpid", "newest.time_us", "newest.event_id", "newest.state")


def learned_addresses(packets: DataFrame) -> DataFrame:
    """Port on which each address was last seen, updated by every batch."""
    newest = F.max(F.struct("time_us", "packet_id", "in_port"))
    return (
        drop_lldp(packets).groupBy("dpid", F.col("eth_src").alias("mac")).agg(newest.alias("newest"))
        .select("dpid", "mac", "newest.time_us", "newest.packet_id", "newest.in_port")
    )


def block_sightings(flagged: DataFrame, idle_seconds: int = IDLE_SECONDS, hard_seconds: int = HARD_SECONDS,
                    tolerance: str = "1 hour") -> DataFrame:
    """Sightings per match and bin, updated by every batch; ``block_episodes`` reads episodes from them.

    ``tolerance`` is how late a sighting may arrive; bins behind it leave the state.
    """
    life = lifetime(idle_seconds, hard_seconds)
    timed = flagged.withColumn("seen", F.timestamp_micros("time_us")).withWatermark("seen", tolerance)
    bins = timed.groupBy(*MATCH, F.window("seen", f"{life} microseconds").alias("w")).agg(
        F.min("time_us").alias("first"), F.max("time_us").alias("last"), F.count(F.lit(1)).alias("n"))
    return bins.select(*MATCH, F.unix_micros("w.start").alias("bin"), "first", "last", "n")


def block_episodes(spark: SparkSession, path: str, idle_seconds: int = IDLE_SECONDS,
                   hard_seconds: int = HARD_SECONDS) -> DataFrame:
    """All episodes so far, open ones included, from the bins that ``upsert`` wrote to ``path``."""
    return joined_bins(current(spark, path, [*MATCH, "bin"]), lifetime(idle_seconds, hard_seconds))


def upsert(state: DataFrame, path: str, checkpoint: str, mode: str = "update",
           interval: str | None = None) -> StreamingQuery:
    """Write each batch's changes to a folder of its own, replaced if the batch is retried."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = state.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key over all batches written by ``upsert``."""
    changes = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), "batch").alias("row")).select(*keys, "row.*")

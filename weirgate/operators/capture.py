"""Labelled capture: flow entries to flat records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORWARD_PRIORITY = 1
POLL_SECONDS = 10


def flow_records(entries: DataFrame) -> DataFrame:
    """Flow entries with a match map to flat records; a missing match field is null."""
    def field(key: str):
        return F.try_element_at("match", F.lit(key))

    return entries.select(
        *[c for c in ("flow_id",) if c in entries.columns], "time_us", "dpid",
        field("in_port").cast("int").alias("in_port"),
        field("eth_src").alias("eth_src"),
        field("eth_dst").alias("eth_dst"),
        F.col("packet_count").alias("packets"),
        F.col("byte_count").alias("bytes"),
        "duration_sec",
    )


def normal_capture(entries: DataFrame) -> DataFrame:
    """Every entry, labelled 0."""
    return flow_records(entries).withColumn("label", F.lit(0))


def attack_capture(entries: DataFrame, poll_seconds: int = POLL_SECONDS) -> DataFrame:
    """Entries of learned flows only, labelled 1, each reply in (port, destination) order.

    The replies are laid out by a range-partitioned sort that ends on the unique
    id, so a large reply is split over tasks. A stream is not sorted.
    """
    poll = F.floor(F.col("time_us") / (poll_seconds * 1_000_000)).cast("bigint")
    records = flow_records(entries.filter(F.col("priority") == FORWARD_PRIORITY))
    labelled = records.withColumn("label", F.lit(1)).withColumn("poll", poll)
    if entries.isStreaming:
        return labelled
    return labelled.orderBy("poll", "dpid", "in_port", "eth_dst", *[c for c in ("flow_id",) if c in labelled.columns])


def labelled_union(normal: DataFrame, attack: DataFrame) -> DataFrame:
    return normal.unionByName(attack.select(*normal.columns))

"""Batch forms of the controller state: switches, learned addresses, block list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.functions.cleaning import drop_lldp
from weirgate.operators.asof import SLICE_ROWS, asof_last
from weirgate.operators.evaluate import slice_edges
from weirgate.workspace import broadcast_if_small

# Block rule lifetime in seconds and rule priorities.
IDLE_SECONDS, HARD_SECONDS = 60, 120
PRIORITY_DROP, PRIORITY_FORWARD, PRIORITY_DEFAULT = 100, 1, 0
# The state that registers a switch and those that unregister it, live and when capturing.
JOINS, LEAVES, CAPTURE_LEAVES = "MAIN", ("DEAD",), ("CONFIG",)
MATCH = ["dpid", "in_port", "eth_src", "eth_dst"]
SECOND = 1_000_000


def latest_state(events: DataFrame, leaves: tuple[str, ...] = LEAVES) -> DataFrame:
    """Last state per switch among those that register or unregister it; partial aggregation absorbs a busy switch.

    The live monitor unregisters on DEAD, the capture programs on CONFIG; other states change nothing.
    """
    return events.filter(F.col("state").isin(JOINS, *leaves)).groupBy("dpid").agg(F.max_by("state", F.struct("time_us", "event_id")).alias("state"))


def active_switches(events: DataFrame, leaves: tuple[str, ...] = LEAVES) -> DataFrame:
    return latest_state(events, leaves).filter(F.col("state") == JOINS).select("dpid")


def mac_table(packets: DataFrame) -> DataFrame:
    """Port on which each address was last seen, per switch."""
    return (
        drop_lldp(packets).groupBy("dpid", F.col("eth_src").alias("mac"))
        .agg(F.max_by("in_port", F.struct("time_us", "packet_id")).alias("in_port"))
    )


def mac_lookup(packets: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Output port of every packet: the port last learned for its destination, null to flood.

    A packet teaches its source before its destination is looked up.
    """
    seen = drop_lldp(packets)
    learned = seen.select("dpid", F.col("eth_src").alias("mac"), "time_us", "packet_id", "in_port")
    asked = seen.select("packet_id", "time_us", "dpid", F.col("eth_dst").alias("mac"))
    return asof_last(asked, learned, ["dpid", "mac"], "in_port", "out_port", tie="packet_id",
                     slice_rows=slice_rows).withColumnRenamed("mac", "eth_dst")


def block_candidates(flagged: DataFrame, active: DataFrame) -> DataFrame:
    """Flagged rows that can be blocked: their switch is active and the port is known."""
    return flagged.filter("in_port IS NOT NULL").join(broadcast_if_small(active), "dpid", "left_semi")


def unblockable(flagged: DataFrame, active: DataFrame) -> DataFrame:
    """Flagged rows that cannot be blocked, with the reason."""
    known = broadcast_if_small(active.select("dpid", F.lit(True).alias("is_active")))
    joined = flagged.join(known, "dpid", "left")
    why = F.when(F.col("is_active").isNull(), "inactive_switch").when(F.col("in_port").isNull(), "no_port")
    return joined.withColumn("reason", why).drop("is_active").filter("reason IS NOT NULL")


def lifetime(idle_seconds: int, hard_seconds: int) -> int:
    """Microseconds a block rule lives after a sighting: every sighting installs it anew and restarts both timers."""
    return min(idle_seconds, hard_seconds) * SECOND


def sighting_bins(flagged: DataFrame, life: int) -> DataFrame:
    """Sightings per match in bins no wider than a rule lives: first, last, n."""
    return flagged.groupBy(*MATCH, F.floor(F.col("time_us") / life).cast("bigint").alias("bin")).agg(
        F.min("time_us").alias("first"), F.max("time_us").alias("last"), F.count(F.lit(1)).alias("n"))


def joined_bins(bins: DataFrame, life: int) -> DataFrame:
    """Episodes from bins: a sighting while the rule lives prolongs it."""
    order = Window.partitionBy(*MATCH).orderBy("first")
    gap = F.col("first") - F.lag("last").over(order)
    numbered = bins.withColumn("fresh", F.when(gap <= life, 0).otherwise(1)).withColumn(
        "episode", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy(*MATCH, "episode")
        .agg(F.min("first").alias("start_us"), F.max("last").alias("last_us"), F.sum("n").alias("sightings"))
        .select(*MATCH, "start_us", "last_us", (F.col("last_us") + life).alias("end_us"), "sightings",
                F.lit(PRIORITY_DROP).alias("priority"))
    )


def block_episodes(
    flagged: DataFrame, idle_seconds: int = IDLE_SECONDS, hard_seconds: int = HARD_SECONDS
) -> DataFrame:
    """Block intervals per match: sightings no further apart than a rule lives form one episode.

    An episode ends one lifetime (the shorter of idle and hard time) after its last
    sighting, since each sighting renews the rule. Sightings in one bin of that width
    collapse to (first, last, n) before the shuffle; what a window then orders
    per match is bounded by time, not by traffic. Missing match fields are equal to each other.
    """
    life = lifetime(idle_seconds, hard_seconds)
    return joined_bins(sighting_bins(flagged, life), life)


def effective_action(
    flows: DataFrame, episodes: DataFrame, packets: DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """What the highest-priority live rule does with each flow row.

    drop while a block episode covers it, else forward if its destination was
    learned, else to the controller. Episodes of one match never overlap, so the
    last one started is the only one that can cover a row.
    """
    starts = episodes.select(
        *MATCH, F.col("start_us").alias("time_us"), F.lit(-1).cast("bigint").alias("flow_id"), "end_us")
    # Episodes and learned addresses come from the same flows: one set of time slices serves both.
    edges = slice_edges(flows, "time_us", slice_rows // 2)
    covered = asof_last(flows.select("flow_id", "time_us", *MATCH), starts, MATCH, "end_us", "until",
                        tie="flow_id", edges=edges, null_safe=True)
    learned = drop_lldp(packets).select(
        "dpid", F.col("eth_src").alias("mac"), "time_us", F.col("packet_id").alias("flow_id"), "in_port")
    known = asof_last(covered.withColumn("mac", F.col("eth_dst")), learned, ["dpid", "mac"], "in_port",
                      "out_port", tie="flow_id", edges=edges)
    dropped = F.coalesce(F.col("time_us") < F.col("until"), F.lit(False))
    forwarded = F.col("out_port").isNotNull()
    return known.select(
        "flow_id", *MATCH,
        F.when(dropped, "drop").when(forwarded, "forward").otherwise("controller").alias("action"),
        F.when(dropped, PRIORITY_DROP).when(forwarded, PRIORITY_FORWARD)
        .otherwise(PRIORITY_DEFAULT).alias("priority"),
    )

"""Profiles of flow-table responses (one row per flow, see ``sources.flow_json``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.functions.cleaning import ethertype_name, first_present

# Match fields that carry an IP address.
IP_FIELDS = ["ipv4_src", "ipv4_dst", "nw_src", "nw_dst", "ip_src", "ip_dst", "IPv4_src", "IPv4_dst"]
ETHERTYPE_FIELDS = ["eth_type", "dl_type"]
HEAD_FLOWS = 5


def _share(count, total):
    return F.round(count * 100.0 / total.cast("double"), 4)


def flows_per_switch(switches: DataFrame, flows: DataFrame) -> DataFrame:
    """Flow count of every listed switch, zero included."""
    counts = flows.groupBy("dpid").agg(F.count(F.lit(1)).alias("n"))
    return (
        switches.select("dpid").distinct().join(counts, "dpid", "left")
        .select("dpid", F.coalesce("n", F.lit(0)).cast("bigint").alias("flows"))
    )


def field_frequency(flows: DataFrame) -> DataFrame:
    """How many flows of a switch carry each match field.

    Every flow also counts once under a null field, which is the switch total: one
    pass, and the window sees only the counts.
    """
    fields = flows.select("dpid", F.explode(F.array_append(F.map_keys("match"), F.lit(None))).alias("field"))
    counted = fields.groupBy("dpid", "field").agg(F.count(F.lit(1)).alias("flows"))
    total = F.max(F.when(F.col("field").isNull(), F.col("flows"))).over(Window.partitionBy("dpid"))
    shares = counted.select("dpid", "field", "flows", _share(F.col("flows"), total).alias("pct")).filter("field IS NOT NULL")
    return shares.withColumn("position", _position("field"))


def _position(column: str):
    """Place in the listing of a switch, which is sorted by ``column``: a window over counts, not flows."""
    return F.row_number().over(Window.partitionBy("dpid").orderBy(column))


def ip_fields(flows: DataFrame) -> DataFrame:
    """The IP match fields in use, per switch."""
    return field_frequency(flows).filter(F.col("field").isin(IP_FIELDS)).select("dpid", "field", "flows")


def ethertypes(flows: DataFrame) -> DataFrame:
    """Ethertype distribution per switch, under either field name."""
    code = first_present(F.col("match"), ETHERTYPE_FIELDS)
    counted = flows.groupBy("dpid", code.alias("eth_type")).agg(F.count(F.lit(1)).alias("flows"))
    total = F.sum("flows").over(Window.partitionBy("dpid"))
    return counted.select(
        "dpid", "eth_type", ethertype_name(F.col("eth_type")).alias("name"), "flows",
        _share(F.col("flows"), total).alias("pct"), _position("eth_type").alias("position"))


def first_flows(flows: DataFrame, n: int = HEAD_FLOWS) -> DataFrame:
    """The first ``n`` flows of every response, one row per match field.

    A flow with an empty match keeps one row with nulls.
    """
    return flows.filter(F.col("position") <= n).select(
        "dpid", "poll_id", "position", "packet_count", "byte_count",
        F.explode_outer("match").alias("field", "value"))


def summary(switches: DataFrame, flows: DataFrame) -> DataFrame:
    """Per switch and overall (null dpid): flows, and whether any IP field is matched on."""
    has_ip = F.exists(F.map_keys("match"), lambda f: f.isin(IP_FIELDS)).cast("int")
    counted = flows.groupBy("dpid").agg(F.count(F.lit(1)).alias("n"), F.sum(has_ip).alias("ip"))
    per_switch = switches.select("dpid").distinct().join(counted, "dpid", "left").select(
        "dpid", F.coalesce("n", F.lit(0)).alias("flows"), F.coalesce("ip", F.lit(0)).alias("ip_flows"))
    return per_switch.rollup("dpid").agg(
        F.sum("flows").alias("flows"), F.sum("ip_flows").alias("ip_flows"),
        (F.sum("ip_flows") > 0).alias("has_ip_fields"))

"""Flow tables derived from the ``events`` table.

The derivations are row-wise (the flow-table documents group at most
``RESPONSE_FLOWS`` rows each), so the work grows with the input and no group
can become hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.functions.cleaning import null_text

RESPONSE_FLOWS = 100

# Published accuracies, used as vote weights (svm never votes in the fixture).
WEIGHTS = {"knn": 0.9771, "random_forest": 0.9763, "decision_tree": 0.9720, "svm": 0.8764}

EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _keyed(ev: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    packets = F.floor(F.col("value") * 100).cast("bigint") * (k + 1)
    size = 64 + F.col("event_id") % 1400
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"),
        k.alias("k"),
        packets.alias("packets"),
        (packets * size).alias("bytes"),
        (F.col("event_id") % 4000).alias("ds"),
        ((F.col("event_id") * 7919) % 1000000000).alias("dns"),
    )


def _label(k):
    attack = (F.col("event_type") == "error") | (F.col("value") > 60)
    return F.when(k == 97, F.lit(None)).when(attack, 1).otherwise(0).cast("int")


def _host(prefix: str, n):
    return F.concat(F.lit(prefix), (n % 6 + 1).cast("string"))


def flow_stats_raw(ev: DataFrame) -> DataFrame:
    """Captured records with the text sentinel still in place."""
    k, uid, eid = F.col("k"), F.col("user_id"), F.col("event_id")
    mac = "00:00:00:00:00:0"
    return _keyed(ev).select(
        eid.alias("flow_id"),
        "time_us",
        F.when(k != 99, uid % 3 + 1).alias("dpid"),
        F.when(k != 98, (uid % 6 + 1).cast("int")).alias("in_port"),
        F.when(k == 98, "NULL").when(k == 13, "00:00:00:00:00:00")
        .when(k == 14, "ff:ff:ff:ff:ff:ff").otherwise(_host(mac, uid)).alias("eth_src"),
        F.when(k == 98, "NULL").when(k == 15, "AA:aa:AA:aa:AA:aa:")
        .otherwise(_host(mac, eid * 7)).alias("eth_dst"),
        "packets", "bytes",
        F.col("ds").alias("duration_sec"),
        F.when(k.isin(98, 99), 0).otherwise(1).cast("int").alias("priority"),
        _label(k).alias("label"),
    )


def flow_stats(ev: DataFrame) -> DataFrame:
    """Flow records with real nulls for missing match fields."""
    return flow_stats_raw(ev).withColumns({c: null_text(F.col(c)) for c in ("eth_src", "eth_dst")})


def flow_features(ev: DataFrame) -> DataFrame:
    k, uid, eid = F.col("k"), F.col("user_id"), F.col("event_id")
    p, b, ds, dns = (F.col(c).cast("double") for c in ("packets", "bytes", "ds", "dns"))

    def rate(amount, per):
        return F.when(per == 0, float("inf")).otherwise(F.try_divide(amount, per))

    icmp = k % 10 == 0
    return _keyed(ev).select(
        F.col("time_us").alias("timestamp"),
        eid.alias("flow_id"),
        (uid % 3 + 1).alias("datapath_id"),
        _host("10.1.1.", uid).alias("ip_src"),
        _host("10.1.1.", eid * 7).alias("ip_dst"),
        _host("00:00:00:00:00:0", uid).alias("eth_src"),
        _host("00:00:00:00:00:0", eid * 7).alias("eth_dst"),
        F.when(icmp, F.lit(None)).when(k % 2 == 0, 443).otherwise(80).cast("int").alias("tp_src"),
        F.when(~icmp, 1024 + k % 7).cast("int").alias("tp_dst"),
        F.when(icmp, 1).when(k % 3 == 0, 17).otherwise(6).cast("int").alias("ip_proto"),
        F.when(icmp, 0).cast("int").alias("icmp_code"),
        F.when(icmp, 8).cast("int").alias("icmp_type"),
        F.when(k % 4 == 0, "S").when(k % 4 == 1, "SA").alias("flags"),
        F.when(k != 55, ds).alias("flow_duration_sec"),
        dns.alias("flow_duration_nsec"),
        F.when(k % 5 == 0, 60.0).otherwise(0.0).alias("idle_timeout"),
        F.lit(0.0).alias("hard_timeout"),
        p.alias("packet_count"),
        b.alias("byte_count"),
        rate(p, ds).alias("packet_count_per_second"),
        rate(p, dns).alias("packet_count_per_nsecond"),
        rate(b, ds).alias("byte_count_per_second"),
        rate(b, dns).alias("byte_count_per_nsecond"),
        _label(k).alias("label"),
    )


def add_votes(flows: DataFrame) -> DataFrame:
    """Fixed votes as columns of the flow row: three models that err on known rows, one that failed."""
    fid, y = F.col("flow_id"), F.col("label")

    def noisy(every: int):
        return ((y + (fid % every == 0).cast("int")) % 2).cast("int")

    return flows.select(
        "*",
        y.alias("y"),
        noisy(37).alias("knn"),
        noisy(53).alias("random_forest"),
        F.when(fid % 101 != 0, noisy(41)).alias("decision_tree"),
        F.lit(None).cast("int").alias("svm"),
    )


def voted_flows(ev: DataFrame) -> DataFrame:
    """Labelled flow rows with their votes."""
    return add_votes(flow_stats(ev).filter(F.col("label").isNotNull()))


def model_votes(ev: DataFrame) -> DataFrame:
    return voted_flows(ev).select("flow_id", "y", *WEIGHTS)


def switch_state(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_type").isin("signup", "error")).select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"),
        (F.col("user_id") % 3 + 1).alias("dpid"),
        F.when(F.col("event_type") == "signup", "MAIN").otherwise("DEAD").alias("state"),
    )


def packets(ev: DataFrame) -> DataFrame:
    tail = F.col("flow_id") % 10
    return (
        flow_stats_raw(ev)
        .filter("dpid IS NOT NULL AND in_port IS NOT NULL")
        .select(
            F.col("flow_id").alias("packet_id"), "time_us", "dpid", "in_port", "eth_src", "eth_dst",
            F.when(tail == 0, 35020).when(tail < 3, 2054).otherwise(2048).cast("int").alias("ethertype"),
        )
    )


def poll_of(flow_id: str):
    return F.floor(F.col(flow_id) / RESPONSE_FLOWS).cast("bigint").alias("poll_id")


def match_maps(ev: DataFrame) -> DataFrame:
    """Flow entries as a switch reports them: a map of the match fields present, plus counters."""
    fid = F.col("flow_id")

    def entry(key: str, value):
        return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))

    entries = F.array_compact(F.array(
        entry("in_port", F.col("in_port")),
        entry("eth_src", F.col("eth_src")),
        entry("eth_dst", F.col("eth_dst")),
        entry("eth_type", F.when(fid % 3 == 0, "2048")),
        entry("dl_type", F.when(fid % 3 == 1, "0x0806")),
        entry("ipv4_src", F.when(fid % 4 == 0, "10.1.1.1")),
    ))
    return flow_stats(ev).select(
        "flow_id", "time_us", "dpid", "priority", "duration_sec", "label",
        F.map_from_entries(entries).alias("match"),
        F.col("packets").alias("packet_count"),
        F.col("bytes").alias("byte_count"),
    )


def flow_json(ev: DataFrame) -> DataFrame:
    """Flow-table responses: one JSON document per switch and poll.

    A poll covers ``RESPONSE_FLOWS`` consecutive ids, which bounds every document.
    """
    document = F.to_json(F.struct("match", "packet_count", "byte_count"))
    return (
        match_maps(ev)
        .filter(F.col("dpid").isNotNull() & F.try_element_at("match", F.lit("in_port")).isNotNull())
        .groupBy("dpid", poll_of("flow_id"))
        .agg(F.array_sort(F.collect_list(F.struct("flow_id", document.alias("doc")))).alias("docs"))
        .select("dpid", "poll_id",
                F.concat(F.lit("["), F.array_join(F.col("docs.doc"), ","), F.lit("]")).alias("flows_json"))
    )


def switch_lists(ev: DataFrame) -> DataFrame:
    """Switch-list responses: one JSON array of active ids per poll."""
    return (
        flow_stats(ev)
        .filter("dpid IS NOT NULL")
        .groupBy(poll_of("flow_id"))
        .agg(F.to_json(F.sort_array(F.collect_set("dpid"))).alias("switches_json"))
    )

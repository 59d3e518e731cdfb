"""Explicit schemas and the fixed column lists of the flow tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Live flow records. Time is epoch microseconds, so comparisons are exact.
FLOW_STATS = T.StructType([
    T.StructField("time_us", T.LongType()),
    T.StructField("dpid", T.LongType()),
    T.StructField("in_port", T.IntegerType()),
    T.StructField("eth_src", T.StringType()),
    T.StructField("eth_dst", T.StringType()),
    T.StructField("packets", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("duration_sec", T.LongType()),
])

LABELLED_STATS = T.StructType(FLOW_STATS.fields + [T.StructField("label", T.IntegerType())])

# Identifiers never used as features.
IGNORED = ["timestamp", "flow_id", "datapath_id", "ip_src", "ip_dst", "eth_src", "eth_dst"]

# Numeric feature columns, in model order.
NUMERIC = [
    "flow_duration_sec", "flow_duration_nsec", "packet_count", "byte_count",
    "packet_count_per_second", "packet_count_per_nsecond",
    "byte_count_per_second", "byte_count_per_nsecond",
    "idle_timeout", "hard_timeout",
]

# Categorical feature columns, in model order.
CATEGORICAL = ["ip_proto", "icmp_code", "icmp_type", "flags", "tp_src", "tp_dst"]

LABEL = "label"

FLOW_FEATURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("timestamp", "flow_id", "datapath_id")]
    + [T.StructField(c, T.StringType()) for c in ("ip_src", "ip_dst", "eth_src", "eth_dst")]
    + [T.StructField(c, T.IntegerType()) for c in ("tp_src", "tp_dst", "ip_proto", "icmp_code", "icmp_type")]
    + [T.StructField("flags", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "flow_duration_sec", "flow_duration_nsec", "idle_timeout", "hard_timeout",
        "packet_count", "byte_count", "packet_count_per_second", "packet_count_per_nsecond",
        "byte_count_per_second", "byte_count_per_nsecond")]
    + [T.StructField("label", T.IntegerType())]
)

# One flow-table response: an array of flows with a free-form match map.
FLOW_TABLE_JSON = (
    "ARRAY<STRUCT<match: MAP<STRING, STRING>, packet_count: BIGINT, byte_count: BIGINT>>"
)

MODEL_NAMES = ["knn", "random_forest", "decision_tree", "svm"]

"""Flow-table and switch-list documents, landed as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.schemas import FLOW_TABLE_JSON


def parse_flows(responses: DataFrame) -> DataFrame:
    """(dpid, poll_id, flows_json) to one row per flow with its position in the response."""
    return listed_flows(responses.select("dpid", "poll_id", F.from_json("flows_json", FLOW_TABLE_JSON).alias("flows")))


def listed_flows(responses: DataFrame) -> DataFrame:
    """(dpid, poll_id, flows) to one row per flow with its position in the response."""
    flows = F.coalesce("flows", F.array().cast(FLOW_TABLE_JSON))
    return (
        responses.select("dpid", "poll_id", F.posexplode(flows).alias("pos", "flow"))
        .select("dpid", "poll_id", (F.col("pos") + 1).alias("position"),
                F.coalesce("flow.match", F.create_map().cast("map<string,string>")).alias("match"),
                F.coalesce("flow.packet_count", F.lit(0)).cast("bigint").alias("packet_count"),
                F.coalesce("flow.byte_count", F.lit(0)).cast("bigint").alias("byte_count"))
    )


def parse_switches(responses: DataFrame, column: str = "switches_json") -> DataFrame:
    """Switch-list documents to one row per switch and response."""
    others = [c for c in responses.columns if c != column]
    return responses.select(*others, F.explode(F.from_json(column, "array<bigint>")).alias("dpid"))


def read_flow_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one file each: an object keyed by switch id, as the API returns it.

    The switch id inside the document is the key; a file holds one switch.
    """
    documents = spark.read.text(path, wholetext=True).select(
        F.from_json("value", f"MAP<STRING, {FLOW_TABLE_JSON}>").alias("doc"),
        F.xxhash64(F.input_file_name()).alias("poll_id"))
    listed = documents.select("poll_id", F.explode("doc").alias("dpid", "flows"))
    return listed_flows(listed.select(F.col("dpid").cast("bigint").alias("dpid"), "poll_id", "flows"))


def read_switch_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_switches(spark.read.text(path, wholetext=True).withColumnRenamed("value", "switches_json"))

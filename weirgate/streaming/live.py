"""Live detection: rules, storage, scoring, vote and block list per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weirgate.functions.rules import judge
from weirgate.operators.state import PRIORITY_DROP, block_candidates
from weirgate.operators.voting import verdict_summary, weighted_vote
from weirgate.sources.flow_files import CSV_OPTIONS

# Poll intervals of the live and attack loops, and of the normal capture.
LIVE_INTERVAL, CAPTURE_INTERVAL = "10 seconds", "5 seconds"


def read_polls(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """Stream of landed polls, one new CSV file per poll.

    Growth of a file already read is not seen, so producers must land new files.
    """
    reader = spark.readStream.schema(schema).options(**CSV_OPTIONS)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).csv(path)


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def store(stream: DataFrame, path: str, checkpoint: str, interval: str | None = LIVE_INTERVAL) -> StreamingQuery:
    """Append a stream to a Parquet table, each row exactly once.

    ``interval`` None reads what has landed and stops.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start(path)


def judge_to(stream: DataFrame, path: str, checkpoint: str, interval: str | None = LIVE_INTERVAL) -> StreamingQuery:
    """Apply the rules to a stream and append every row with its reasons."""
    return store(judge(stream), path, checkpoint, interval)


@dataclass
class LivePipeline:
    """One micro-batch of live detection.

    ``score`` adds one nullable vote column per name in ``weights``; ``active``
    reads the switches that are connected now. Every output of a batch goes to a
    folder of its own that is replaced when the batch is retried, so a restart
    repeats nothing.
    """

    score: Callable[[DataFrame], DataFrame]
    weights: dict[str, float]
    active: Callable[[], DataFrame]
    root: str
    normalize: bool = False

    def _write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch_id}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        judged = judge(batch).persist()
        spark = batch.sparkSession
        # Live records carry no id of their own; one that is there is kept.
        match = [c for c in ("flow_id", "time_us", "dpid", "in_port", "eth_src", "eth_dst") if c in batch.columns]
        # Rules come first: what they flag is blocked and not stored.
        self._write(judged.filter(~F.col("blocked")).drop("reasons", "blocked"), "stored", batch_id)
        stored = spark.read.parquet(f"{self.root}/stored/batch={batch_id}")
        votes = {m: F.col(m) for m in self.weights}
        verdict = weighted_vote(votes, self.weights, self.normalize)
        self._write(self.score(stored).withColumn("verdict", verdict), "verdicts", batch_id)
        verdicts = spark.read.parquet(f"{self.root}/verdicts/batch={batch_id}")
        by_rule = judged.filter("blocked").select(*match, F.lit("rule").alias("cause"))
        by_vote = verdicts.filter("verdict = 1").select(*match, F.lit("vote").alias("cause"))
        blocks = block_candidates(by_rule.unionByName(by_vote), self.active())
        self._write(blocks.withColumn("priority", F.lit(PRIORITY_DROP)), "blocks", batch_id)
        self._write(verdict_summary(verdicts), "summary", batch_id)
        judged.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = LIVE_INTERVAL) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return _trigger(writer, interval).start()

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}").drop("batch")

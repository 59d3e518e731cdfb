"""Raw documents to shards: language, near copies, benchmark passages, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of ``docs``. Rows with null text have no language and go in the first stage;
empty tables stay empty; columns beyond doc_id, text, source are carried through unread, whatever their names, since
stages hold each row in one struct beside their own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm import bloom, decontaminate, jaccard, language, mixing, shards
from weirgate.llm.queries import SHARDS, SOURCE_WEIGHTS, read
from weirgate.workspace import cut_lineage

#: Near copies in the pipeline: shingles of five words, similarity 0.8.
WIDTH, PERCENT = 5, 80
#: A text is in no language when its bits a byte exceed its language's upper quartile by so many quartile ranges, and
#: by so large a share of it. No fixed number of bits rejects a text: the corpus decides.
FENCE, SHARE = 6.0, 1.5
#: Rows of whole texts that Spark and a Python worker hold at once; long texts make larger batches a burden.
ARROW_ROWS, ARROW_CONF = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go when their query has ended, not when the driver happens to collect its plan. Lost ones are made anew.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language: those without any letter go, and those whose code length is far out for their language.

    Per predicted language the quartiles of bits a byte over all rows make the bound. Where no row has a
    language there is nothing to learn, and all rows with a letter stay. Texts are coded twice, which is cheaper
    than writing them once more between both passes. From here on the session sends rows to Python in batches of
    ``ARROW_ROWS`` at most.
    """
    now = int(spark.conf.get(ARROW_CONF))
    spark.conf.set(ARROW_CONF, min(now, ARROW_ROWS) if now > 0 else ARROW_ROWS)
    model = language.fit(docs)
    lettered = docs.filter(F.coalesce(F.col("text").rlike(language.LETTER), F.lit(False)))
    if not model.langs:
        return lettered
    held = lettered.select(F.struct("*").alias("row"), language.coded(F.col("text"), model, spark).alias("found"))
    bits = F.col("found.bits_per_byte")
    quartiles = held.groupBy(F.col("found.best").alias("lang")).agg(F.percentile_approx(bits, [0.25, 0.75], 10_000).alias("q"))
    bound = F.greatest(F.col("q")[1] + FENCE * (F.col("q")[1] - F.col("q")[0]), F.col("q")[1] * SHARE)
    bounds = F.broadcast(cut_lineage(quartiles.select("lang", bound.alias("bound"))))  # a row per learned language
    return held.join(bounds, F.col("found.best") == F.col("lang")).filter(bits <= F.col("bound")).select("row.*")


def _row_key() -> Column:
    """What a row is told apart by: its doc_id and its text's hashes, ordered by doc_id with nulls last.

    A null or repeated doc_id so stands for one text only, and no table with row numbers has to be written.
    """
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("doc_id"),
                    F.xxhash64(F.lit(1), "text").alias("high"), F.xxhash64(F.lit(2), "text").alias("low"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key().alias("key"), "text")


def _held(docs: DataFrame) -> DataFrame:
    """Rows in one struct beside their keys."""
    return docs.select(F.struct("*").alias("row"), _row_key().alias("key"))


def _split(held: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in ``keys``, and the others."""
    bitmap = bloom.shared(keys.select(F.xxhash64("key").alias("hash")))
    return bloom.split(held, F.xxhash64("key"), bitmap)


def _without(held: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in ``gone``."""
    maybe, rest = _split(held, gone)
    same = [F.col(f"key.{c}").eqNullSafe(F.col(f"gone.{c}")) for c in ("high", "low", "doc_id")]
    return rest.unionByName(maybe.join(gone.select(F.col("key").alias("gone")), same, "left_anti"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that of the smallest doc_id. Rows without words stay as they are.

    Of rows that repeat doc_id and text one stays; rows of a class that share only the smallest doc_id both stay. A
    null doc_id stays unless its class has a doc_id. Rows are judged by doc_id and text, so that no row goes for another's
    text. From here on the session drops the shuffle files of queries that have ended.
    """
    spark.conf.set(CLEANUP_CONF, "true")
    found = cut_lineage(jaccard.link(_keyed(docs), WIDTH, PERCENT, key="key")).filter("n_shingles > 0")
    later = found.filter("component_id.doc_id IS NOT NULL AND NOT key.doc_id <=> component_id.doc_id").select("key")
    first = _without(_held(docs), cut_lineage(later.distinct()))
    twice = found.filter("key.doc_id = component_id.doc_id").groupBy("key").count().filter("count > 1").select("key")
    repeated, single = _split(first, twice)
    once = repeated.filter("NOT key.nameless").dropDuplicates(["key"])
    return single.unionByName(once).unionByName(repeated.filter("key.nameless")).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no passage with the benchmark, judged one by one."""
    found = decontaminate.contaminated(_keyed(docs), read(spark, sf_dir, "benchmark"), key="key")
    return _without(_held(docs), cut_lineage(found.select("key").distinct())).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: never, once or twice. Rows that share a doc_id are taken one by one."""
    mixed = mixing.mix(docs, SOURCE_WEIGHTS, carry=True)
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row that is left."""
    return shards.shard_rows(docs, [1.0] * SHARDS)


STAGES = [
    ("language id", language_stage), ("near copies", near_copy_stage), ("decontamination", decontamination_stage),
    ("mixing", mixing_stage), ("sharding", sharding_stage),
]

#: None: SQL cannot express the language model, the spaced seeds or the search for near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs

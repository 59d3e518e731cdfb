"""Small tables with every awkward case, and the words to build texts from."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves; a table may bring them along.
CLASHING = ["size", "node", "cell", "shard", "spans", "kept", "_key", "_row", "component_id", "chunk", "unit", "target"]
AWKWARD = [
    (900, None, None, None, None), (901, "", "en", "a", 0), (902, " \t\n\v\f\r ", "en", "a", 6), (903, "one", "en", "b", 3),
    (904, "One", "de", None, 3), (905, "x" * 5000, "en", "a", 5000), (None, "one two three four five six", "en", "a", 27),
    (906, "one two three four five six", None, "b", 27), (906, "one two three four five six", None, "b", 27),
    (907, "été 中文 \U0001f600 naïve", "fr", "é", 15), (-5, "one two three four five six", "en", "a", 27),
]


def words(n: int, seed: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def table(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA)
    if clash:
        for name in CLASHING:
            df = df.withColumn(name, df.doc_id)
    return df


def long_text(seed: int = 1, n: int = 300_000) -> str:
    """Over a megabyte, so that it is walked in pieces."""
    return " ".join(words(n, seed, 10_000))

"""Benchmark decontamination by spaced seeds and substitution-tolerant overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm import bloom
from weirgate.llm.mixing import WORD
from weirgate.llm.text import ODD, mix, rows_of, word_hashes
from weirgate.workspace import broadcast_if_small, cut_lineage

#: Fixed masks over token positions: 1 counts, 0 may hold any word.
MASKS = ("1101101011", "11100110101", "1011010011011")
#: Words on either side of a seed that are compared; least words of an item; words that must agree (all of a shorter
#: item), and the share of agreeing words of an overlap, as the price of one that differs.
REACH, SHORTEST, AGREE, PRICE = 16, 5, 12, 4
SEEDS_SENT = 50_000
#: What is neither a letter, a mark, a number nor whitespace is left out of words.
PUNCTUATION = r"[^\p{L}\p{M}\p{N}\s]+"


def plain(text: Column) -> Column:
    """Text in lower case without punctuation, so that shouting or another mark at a word's end hides nothing."""
    return F.lower(F.regexp_replace(text, F.lit(PUNCTUATION), F.lit("")))


SPACED = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
SPANS = [len(m) for m in MASKS]


def seeds(words: np.ndarray, counts: np.ndarray, which: int, mask: np.ndarray, span: int, whole: bool):
    """Places in a block of rows and their hashes under one mask; ``whole`` wants rows of just the mask's length."""
    n = max(0, len(words) - span + 1)
    sums = np.full(n, np.uint64(which + 1), np.uint64)
    for offset in mask.tolist():
        sums *= ODD
        sums += words[offset:offset + n]
    good = np.arange(n) + span <= np.repeat(np.cumsum(counts), counts)[:n]
    if whole:
        good &= np.repeat(counts == span, counts)[:n]
    at = np.flatnonzero(good)
    return at, mix(sums[at])


def contexts(words: np.ndarray, counts: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words from REACH before a place to the longest mask and REACH after it; 0 outside the row."""
    ends = np.cumsum(counts)
    near = at[:, None] - REACH + np.arange(2 * REACH + max(SPANS))
    inside = (near >= (ends - counts)[row][:, None]) & (near < ends[row][:, None])
    return np.where(inside, words[np.where(inside, near, 0)], np.uint64(0))


def _seeded(short: list[int], items: bool, shared):
    """Seeds of each row with their context; training rows keep those that the tests may have.

    An item too short for the masks is its own seed, which may lie anywhere in training text.
    """
    patterns = [(i, m, s, False) for i, (m, s) in enumerate(zip(SPACED, SPANS))]
    patterns += [(len(MASKS) + n, np.arange(n), n, items) for n in short]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in rows_of(batch):
                words, counts = word_hashes(data, starts)
                owner = np.repeat(np.arange(last - first), counts)
                for which, mask, span, whole in patterns:
                    at, found = seeds(words, counts, which, mask, span, whole)
                    if shared is not None:
                        hit = bloom.holds(shared.value, found)
                        at, found = at[hit], found[hit]
                    for low in range(0, len(at), 20_000):
                        part, row = slice(low, low + 20_000), owner[at[low:low + 20_000]]
                        near = contexts(words, counts, at[part], row)
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(first + row)), pa.array(found[part].view(np.int64)),
                            pa.array(counts[row].astype(np.int64)),
                            pa.array([c.tobytes() for c in near], pa.binary())], ["_id", "seed", "words", "near"])

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Agreeing words and length of the best stretch of each row: one for a word that agrees, less PRICE for another."""
    both = (x != 0) & (y != 0)
    same = both & (x == y)
    gain = np.where(same, 1, np.where(both, -PRICE, -10_000))
    n = len(x)
    best, hits, long = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    score, run_hits, run_long = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    for c in range(x.shape[1]):
        fresh = score <= 0
        score = np.where(fresh, 0, score) + gain[:, c]
        run_hits = np.where(fresh, 0, run_hits) + same[:, c]
        run_long = np.where(fresh, 0, run_long) + 1
        better = score > best
        best, hits, long = np.where(better, score, best), np.where(better, run_hits, hits), np.where(better, run_long, long)
    return hits, long


def contaminated(
    docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", agree: int = AGREE, shortest: int = SHORTEST,
) -> DataFrame:
    """Rows and test items that share a passage, single words of which may have been replaced.

    Words are runs of non-whitespace, lower-cased and without punctuation. Fixed masks over word positions, applied at every place of both
    sides, give seeds; equal seeds are joined, and around each the words are compared one to one: the best stretch,
    where every replaced word costs ``PRICE`` agreeing ones, must hold ``agree`` agreeing words, or all of an item
    with fewer. Items under ``shortest`` words are left out, since they occur anywhere. Returns one row per ``key``
    and ``item`` with agree and length (of the best stretch within reach of a seed). Null and empty texts share nothing;
    null keys and items are kept as such; repeated rows give one result per key. Empty tables give no rows; other
    columns are ignored.
    """
    @F.pandas_udf("struct<agree:long,length:long>")
    def compared(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        a, b = (np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (x, y))
        hits, long = overlap(a, b)
        return pd.DataFrame({"agree": hits, "length": long})

    spark = docs.sparkSession
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, key), (tests, item)))
    schema = "_id {}, seed long, words long, near binary"
    asked = tests.select(F.col(item).alias("_id"), plain(F.col(item_text)).alias("text")) \
        .withColumn("_n", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)))
    short = sorted(r[0] for r in asked.filter((F.col("_n") >= shortest) & (F.col("_n") < min(SPANS))).select("_n").distinct().collect())
    index = cut_lineage(asked.select("_id", "text").mapInArrow(_seeded(short, True, None), schema.format(item_kind)))
    shared = spark.sparkContext.broadcast(bloom.build(index, "seed"))
    hits = docs.select(F.col(key).alias("_id"), plain(F.col(text)).alias("text")) \
        .mapInArrow(_seeded(short, False, shared), schema.format(kind))
    sent = broadcast_if_small(index.select(F.col("_id").alias("_item"), "seed", F.col("words").alias("_words"),
                                           F.col("near").alias("_near")), SEEDS_SENT)
    found = hits.join(sent, "seed").withColumn("_c", compared("near", "_near")) \
        .filter(F.col("_c.agree") >= F.least(F.lit(agree), F.col("_words")))
    return found.groupBy("_id", "_item").agg(F.max(F.struct("_c.agree", "_c.length")).alias("_best")).select(
        F.col("_id").alias(key), F.col("_item").alias(item), F.col("_best.agree").alias("agree"),
        F.col("_best.length").alias("length"))

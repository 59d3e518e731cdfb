"""Quality selection by importance resampling over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.select import KEY_BITS, hash48, take_in_order
from weirgate.llm.text import rows_of, shingles, word_hashes
from weirgate.workspace import cut_lineage

#: Buckets of the hashed n-grams, words of the longest, weight of an unseen bucket, target rows used to fit.
BUCKETS, WIDTH, SMOOTH, FIT_ROWS = 10_000, 2, 1.0, 50_000


def hashed_ngrams(data: np.ndarray, starts: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of 1 to ``width`` words."""
    words, counts = word_hashes(data, starts)
    rows, found = [], []
    for n in range(1, width + 1):
        long = counts >= n
        grams, made = shingles(words[np.repeat(long, counts)], counts[long], n)
        rows.append(np.repeat(np.flatnonzero(long), made))
        found.append((grams % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def _totals(buckets: int, width: int):
    """A task's number of n-grams per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, starts in rows_of(batch):
                total += np.bincount(hashed_ngrams(data, starts, buckets, width)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def _model(texts: DataFrame, buckets: int, width: int) -> np.ndarray:
    """Log shares of the buckets, over all rows of ``texts``; ``buckets`` numbers whatever the input."""
    rows = texts.mapInArrow(_totals(buckets, width), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    counts = np.full(buckets, SMOOTH)
    for bucket, n in rows:
        counts[bucket] += n
    return np.log(counts / counts.sum())


def fit(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, width: int = WIDTH) -> np.ndarray:
    """Log ratio per bucket of a model of the target texts and one of all raw texts."""
    both = [d.select(F.col(text).alias("text")) for d in (target, docs)]
    return _model(both[0], buckets, width) - _model(both[1], buckets, width)


def _weighed(shared, width: int):
    """Each row's log weight, with Gumbel noise, and a long that orders it, largest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            weights = [np.zeros(0)]
            for first, last, data, starts in rows_of(batch):
                row, bucket = hashed_ngrams(data, starts, len(ratio), width)
                weights.append(np.bincount(row, ratio[bucket], minlength=last - first))
            weight = np.concatenate(weights)
            unit = (batch.column("noise").to_numpy(zero_copy_only=False) + 0.5) / (1 << KEY_BITS)
            score = weight - np.log(-np.log(unit))
            bits = (score + 0.0).view(np.int64)
            rising = np.where(bits < 0, ~bits, bits ^ np.int64(-1 << 63)).view(np.uint64)
            order = (~rising >> np.uint64(64 - KEY_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weight), pa.array(score), pa.array(order)], ["_key", "log_weight", "score", "_order"])

    return run


def resample(
    docs: DataFrame, ratio: np.ndarray, share: float, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: str = "gumbel",
) -> DataFrame:
    """A sample without replacement of ``share`` of the rows, in proportion to importance weights.

    A row's log weight is the sum over its hashed n-grams of the log ratio of target to raw. Gumbel noise from a hash of
    the key and the text's length is added, and the rows with the largest sums are taken: so drawn, weights act as
    probabilities. Returns per row ``key``, log_weight, score, selected; just ``floor(share * rows)`` are selected.
    Null and empty texts weigh 0 (as likely target as raw); null keys hash as empty;
    rows equal in score tie, and which of those repeated with key and text is selected is not told apart in the result. An
    empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    scored = cut_lineage(docs.select(
        F.col(key).alias("_key"), F.col(text).alias("text"),
        hash48(F.col(key), F.length(F.col(text)), seed=seed).alias("noise")
    ).mapInArrow(_weighed(shared, width), f"_key {kind}, log_weight double, score double, _order long"))
    wanted = int(scored.count() * share)
    placed = scored.select("*", F.lit(0).alias("_all"), F.lit(1).cast("long").alias("_one"), F.lit(float(wanted)).alias("_need"),
                           (-F.col("score")).alias("_least"))
    return take_in_order(placed, "_all", "_order", "_one", "_need", ["_least", "_key"]).select(
        F.col("_key").alias(key), "log_weight", "score", F.col("chosen").alias("selected"))


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """The rows labelled good: about ``rows`` of them at most, by a hash of the key, so that their keys can be sent everywhere."""
    good = labels.filter("quality = 1").select(key).distinct()
    n = good.count()
    cut = int(min(1.0, rows / n) * (1 << KEY_BITS)) if n else 0
    return docs.join(F.broadcast(good.filter(hash48(F.col(key), seed="fit") < cut)), key, "left_semi")

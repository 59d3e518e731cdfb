"""A set of 64-bit hashes as a bitmap of fixed size, to leave out rows that cannot matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.workspace import cut_lineage, discard

#: log2 of the most bits, and bits per hash below that. Beyond the most, more rows pass; none is ever lost.
BITS, ROOM = 28, 32
PROBES = 2
SLICE = 1 << 16  # bytes of the bitmap that one row carries


def places(hashes: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Bit numbers of 64-bit hashes, from their upper and their lower end."""
    h = hashes.astype(np.uint64, copy=False) * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64((1 << bits) - 1)
    return [(h >> np.uint64(64 - bits)), ((h >> np.uint64(4)) & low)][:PROBES]


def _slices(column: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(np.concatenate(places(batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            at, inside = bit >> np.uint64(6), bit & np.uint64(63)
            words, first = np.unique(at, return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << inside, first) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.astype(np.int64)), pa.array(values.view(np.int64))], ["word", "bits"])

    return run


def _packed(keys, rows):
    out = np.zeros(SLICE // 8, np.int64)
    out[rows["word"].to_numpy() % len(out)] = rows["bits"].to_numpy()
    import pandas as pd
    return pd.DataFrame({"slice": [int(keys[0])], "bytes": [out.tobytes()]})


def build(hashes: DataFrame, column: str, most: int = BITS) -> np.ndarray:
    """The bitmap of a column of longs, put together on the executors in slices; ``2**most / 8`` bytes at most.

    ``hashes`` is read twice: pass a written table.
    """
    bits = min(most, max(19, (hashes.count() * ROOM).bit_length()))
    words = hashes.select(column).mapInArrow(_slices(column, bits), "word long, bits long") \
        .groupBy("word").agg(F.bit_or("bits").alias("bits"))
    per = SLICE // 8
    parts = words.withColumn("slice", F.floor(F.col("word") / per)) \
        .groupBy("slice").applyInPandas(_packed, "slice long, bytes binary").collect()
    full = np.zeros((1 << bits) // 64, np.uint64)
    for row in parts:
        full[row["slice"] * per:(row["slice"] + 1) * per] = np.frombuffer(row["bytes"], np.uint64)
    return full


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False where a hash is certainly not in the set."""
    bits = int(len(bitmap) * 64).bit_length() - 1
    found = np.ones(len(hashes), bool)
    for bit in places(hashes, bits):
        found &= (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found


def shared(hashes: DataFrame):
    """A broadcast bitmap of the only column of ``hashes``."""
    distinct = cut_lineage(hashes.distinct())
    bitmap = build(distinct, hashes.columns[0])
    discard(distinct)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def split(rows: DataFrame, hashed: Column, bitmap) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash may be in a shared bitmap, and those where it certainly is not.

    So that a join on few keys shuffles few rows.
    """
    @F.arrow_udf("boolean")
    def may_be(values: pa.Array) -> pa.Array:
        return pa.array(holds(bitmap.value, values.to_numpy(zero_copy_only=False).view(np.uint64)))

    return rows.filter(may_be(hashed)), rows.filter(~may_be(hashed))

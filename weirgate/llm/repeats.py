"""Removal of byte strings that start in an earlier document, by ranking sampled positions at growing lengths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm import bloom
from weirgate.llm.text import BLOCK, blocks, distinct_sorted, mix, piece_hashes, prefix_sums, utf8
from weirgate.workspace import cut_lineage

#: Length of the strings that count, and bytes of the first rank. The first rank of the long round.
LENGTH, PREFIX = 50, 20
LONG, LONG_PREFIX = 300, 32
#: Positions that one task resolves, and of one rank before they are dealt out by window instead.
BUCKET, HOT = 20_000, 200_000
PLACE = np.uint64((1 << 21) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values, by runs of doubled length."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


def sampled(data: np.ndarray, starts: np.ndarray, length: int, prefix: int, done: np.ndarray | None):
    """Sampled positions of a block of rows of at most BLOCK bytes.

    Every string of ``length`` bytes within a row is represented by the position in it whose first ``prefix`` bytes
    hash lowest, so equal strings are represented alike wherever they lie. Neighbouring strings with one
    representative form a run. Strings that start where ``done`` is true are left out. Returns per run its row, the
    first string's start in the block, the number of strings, and the rank of the representative: its prefix's hash.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), None
    sums = prefix_sums(data)
    place = np.arange(len(data) - prefix + 1)
    rank = piece_hashes(sums, place, place + prefix)
    least = _least((rank & ~PLACE) | place.astype(np.uint64), length - prefix + 1)
    chosen = (least & PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:len(chosen)]
    at = np.arange(len(chosen))
    good = at + length <= starts[row + 1]
    if done is not None:
        good &= ~done[:len(chosen)]
    at, chosen, row = at[good], chosen[good], row[good]
    if not len(at):
        return none, none, none, none.view(np.uint64), None
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return row[first], at[first], count, rank[chosen[first]], sums


def _parts(batch: pa.RecordBatch, length: int):
    """Blocks of rows with the strings already settled; a long row comes in pieces that overlap by ``length`` - 1."""
    if not len(batch):
        return
    data, ends = utf8(batch.column("text"))
    known = "starts" in batch.schema.names
    if known:
        lists = batch.column("starts")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        low, high = (batch.column(c).values.to_numpy().astype(np.int64) for c in ("starts", "ends"))
        owner = np.repeat(np.arange(len(lists)), np.diff(bounds))
        low, high = low[bounds[0]:bounds[-1]], high[bounds[0]:bounds[-1]]
    for first, last in blocks(ends):
        offset = ends[first]
        for piece in range(offset, max(ends[last] - length + 1, offset + 1), BLOCK - length + 1):
            stop = min(piece + BLOCK, ends[last])
            starts = np.clip(ends[first:last + 1], piece, stop) - piece
            done = None
            if known:
                mine = (owner >= first) & (owner < last)
                if mine.any():
                    begin = ends[owner[mine]] + low[mine]
                    finish = ends[owner[mine]] + high[mine] - length + 1
                    size = stop - piece + 1
                    marks = np.zeros(size + 1, np.int64)
                    live = finish > begin
                    np.add.at(marks, np.clip(begin[live] - piece, 0, size), 1)
                    np.add.at(marks, np.clip(finish[live] - piece, 0, size), -1)
                    done = np.cumsum(marks)[:size] > 0
            # the piece's first byte within its row, for rows that are walked in pieces
            yield first, data[piece:stop], starts, done, piece - offset if last == first + 1 else 0


def _unsettled(batch: pa.RecordBatch, settled) -> pa.RecordBatch:
    """The rows that have no ranges of their own elsewhere."""
    if settled is None:
        return batch
    rows = batch.column("_row").to_numpy(zero_copy_only=False).view(np.uint64)
    return batch.filter(pa.array(~bloom.holds(settled.value, rows)))


def _ranks(length: int, prefix: int, settled):
    """Each rank with the number of rows and of positions that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _unsettled(batch, settled)
            for _, data, starts, done, _ in _parts(batch, length):
                row, _, _, rank, _ = sampled(data, starts, length, prefix, done)
                places = np.unique(rank, return_counts=True)[1]  # before the ranks are sorted in place
                once, _ = distinct_sorted(rank, np.bincount(row, minlength=len(starts) - 1))
                found, n = np.unique(once, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(n), pa.array(places)], ["rank", "n", "places"])

    return run


def _runs(length: int, prefix: int, shared, hot, want_hot: bool, carry: bool, settled):
    """Runs whose rank several rows may have, with their bytes (or those bytes' hash)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot_bitmap = shared.value, hot.value if hot else None
        for batch in batches:
            batch = _unsettled(batch, settled)
            for first, data, starts, done, shift in _parts(batch, length):
                row, at, count, rank, sums = sampled(data, starts, length, prefix, done)
                keep = bloom.holds(bitmap, rank)
                if hot_bitmap is not None:
                    keep &= bloom.holds(hot_bitmap, rank) == want_hot
                row, at, count, rank = row[keep], at[keep], count[keep], rank[keep]
                if not len(row):
                    continue
                size = count + length - 1
                content = piece_hashes(sums, at, at + size)
                columns = [batch.column(c).take(pa.array(first + row)) for c in ("_key", "_row")]
                columns += [pa.array(rank.view(np.int64)), pa.array(mix(content).view(np.int64)),
                            pa.array(at - starts[row] + shift), pa.array(size)]
                names = ["_key", "_row", "rank", "content", "start", "size"]
                if carry:
                    ends = np.concatenate([[0], np.cumsum(size)])
                    index = np.repeat(at - ends[:-1], size) + np.arange(ends[-1])
                    columns.append(pa.Array.from_buffers(pa.binary(), len(row), [
                        None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())]))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _joined(low: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers per owner (both ascending)."""
    new = np.ones(len(low), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (low[1:] != low[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(low)) - 1


def window_hashes(pieces: list[bytes], length: int):
    """Two hashes of every string of ``length`` bytes in the pieces, with its piece and its place there."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    out = []
    for first, last in blocks(ends):
        size = np.diff(ends[first:last + 1]) - length + 1
        owner = np.repeat(np.arange(first, last), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = ends[owner] - ends[first] + place
        part = data[ends[first]:ends[last]]
        out.append((owner, place, *(piece_hashes(prefix_sums(part, s), at, at + length, s) for s in (1, 2))))
    return [np.concatenate(x) for x in zip(*out)]


def _resolve(length: int):
    """Ranges of the rows of a bucket that start in a row with a smaller key.

    Runs with equal content are settled whole: all but those of the smallest key go. Where a rank is left with several
    contents, the smallest keys' runs are compared string by string.
    """
    def run(keys, rows: pd.DataFrame) -> pd.DataFrame:
        order = np.unique(rows["_key"].to_numpy(), return_inverse=True)[1]
        rank, content = rows["rank"].to_numpy(), rows["content"].to_numpy()
        start, size = rows["start"].to_numpy(), rows["size"].to_numpy()
        by = np.lexsort((order, content, rank))
        new = np.ones(len(by), bool)
        new[1:] = (rank[by][1:] != rank[by][:-1]) | (content[by][1:] != content[by][:-1])
        group = np.cumsum(new) - 1
        least = np.empty(len(by), np.int64)
        least[by] = order[by][np.flatnonzero(new)][group]
        later = np.flatnonzero(order > least)
        hit, low, high = [later], [start[later]], [start[later] + size[later]]
        kinds = rank[by][new]  # one entry for each content of a rank
        several = kinds[:-1][kinds[1:] == kinds[:-1]]
        rest = np.flatnonzero((order == least) & np.isin(rank, several))
        if len(rest):
            owner, place, one, two = window_hashes(rows["bytes"].iloc[rest].tolist(), length)
            holder = order[rest][owner]
            by = np.lexsort((holder, two, one))
            new = np.ones(len(by), bool)
            new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
            first = holder[by][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = np.zeros(len(by), bool)
            gone[by] = holder[by] > first
            owner, place = owner[gone], place[gone]
            if len(owner):
                a, b = _joined(place, owner)
                hit.append(rest[owner[a]])
                low.append(start[rest[owner[a]]] + place[a])
                high.append(start[rest[owner[a]]] + place[b] + length)
        hit = np.concatenate(hit)
        return pd.DataFrame({"_row": rows["_row"].to_numpy()[hit], "start": np.concatenate(low), "end": np.concatenate(high)})

    return run


def _whole_ranges(runs: DataFrame) -> DataFrame:
    """Ranges of the runs whose content a smaller key has: each content is reduced to its least key and joined back, so that
    its positions never meet in one task."""
    runs = cut_lineage(runs)
    least = cut_lineage(runs.groupBy("rank", "content").agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"))
                        .filter("_least < _most").drop("_most"))
    return runs.join(least, ["rank", "content"]).filter("_key > _least") \
        .select("_row", "start", (F.col("start") + F.col("size")).alias("end"))


def _hot_ranges(runs: DataFrame, length: int) -> DataFrame:
    """The same for ranks with very many positions: every string is a row, so that Spark splits them."""
    parts = runs.withColumn("place", F.explode(F.sequence(F.lit(0), (F.col("size") - length).cast("int")))) \
        .withColumn("window", F.expr(f"substring(bytes, place + 1, {length})")) \
        .select("_key", "_row", (F.col("start") + F.col("place")).alias("start"), "rank", "window")
    parts = cut_lineage(parts.withColumn("high", F.xxhash64(F.lit(1), "window")).withColumn("low", F.xxhash64(F.lit(2), "window"))
                        .drop("window"))
    least = cut_lineage(parts.groupBy("rank", "high", "low").agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"))
                        .filter("_least < _most").drop("_most"))
    return parts.join(least, ["rank", "high", "low"]).filter("_key > _least") \
        .select("_row", "start", (F.col("start") + length).alias("end"))


def repeated_ranges(
    tables: list[tuple], length: int, prefix: int, windows: bool, bucket: int = BUCKET, hot: int = HOT,
) -> DataFrame:
    """Byte ranges (_row, start, end) covered by strings of ``length`` bytes that a row with a smaller ``_key`` also has.

    With ``windows`` all of them, otherwise those in runs that are equal as a whole. ``tables`` are DataFrames of _key, _row,
    text and maybe the ranges already settled, each with a shared bitmap of the rows to leave out, or None.
    (1) Positions are ranked by their first bytes, and ranks of one row drop out; (2) what is left is ranked again by whole
    runs, then, with ``windows``, by all strings of a run, each rank's positions meeting in one task unless there are more than
    ``hot`` of them, repetitions within a row included, which are then dealt out by string.
    """
    kind = tables[0][0].schema["_key"].dataType.simpleString()
    spark = tables[0][0].sparkSession

    def each(task, schema: str) -> DataFrame:
        made = [rows.mapInArrow(task(settled), schema) for rows, settled in tables]
        return reduce(DataFrame.unionByName, made)

    ranks = cut_lineage(each(lambda settled: _ranks(length, prefix, settled), "rank long, n long, places long")
                        .groupBy("rank").agg(F.sum("n").alias("n"), F.sum("places").alias("places")).filter("n > 1"))
    shared = spark.sparkContext.broadcast(bloom.build(ranks, "rank"))
    schema = f"_key {kind}, _row long, rank long, content long, start long, size long"
    if not windows:
        return cut_lineage(_whole_ranges(each(lambda settled: _runs(length, prefix, shared, None, False, False, settled), schema)))
    positions, most = ranks.agg(F.sum("places"), F.max("places")).first()
    busy = None
    if (most or 0) > hot:
        busy = spark.sparkContext.broadcast(bloom.build(ranks.filter(F.col("places") > hot), "rank"))
    full = schema + ", bytes binary"
    buckets = max(1, (positions or 0) // bucket)
    found = each(lambda settled: _runs(length, prefix, shared, busy, False, True, settled), full) \
        .groupBy(F.pmod("rank", F.lit(buckets)).alias("bucket")) \
        .applyInPandas(_resolve(length), "_row long, start long, end long")
    if busy:
        crowded = each(lambda settled: _runs(length, prefix, shared, busy, True, True, settled), full)
        found = found.unionByName(_hot_ranges(crowded, length))
    return cut_lineage(found)


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges joined where they overlap or touch."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:], len(low)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, low, high in zip(*(batch.column(c) for c in ("text", "starts", "ends"))):
            raw = text.as_py().encode()
            low, high = _merged(low.values.to_numpy(), high.values.to_numpy()) if low.is_valid and len(low) else ([], [])
            kept, at = hashlib.sha256(), 0
            for a, b in zip(low, high):
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((len(raw), int(sum(high) - sum(low)), len(low), kept.hexdigest()))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("_key"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
            ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, key: str = "doc_id", text: str = "text",
    bucket: int = BUCKET, hot: int = HOT,
) -> DataFrame:
    """What is left of each text after removing every byte covered by a ``length``-byte string that also starts
    in a text with a smaller key.

    Returns per row ``key``, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the UTF-8 bytes left,
    concatenated). Strings are judged on the input and never cross texts. Null and
    short texts lose nothing; a null key is neither smaller nor larger than any; rows that share a key do not
    remove from each other. An empty table gives no rows; other columns are ignored.

    A first round settles long repeats, so that copies cost a few rows each; the second finds all the rest.
    """
    kind = docs.schema[key].dataType.simpleString()
    whole = docs.select(F.col(key).alias("_key"), F.xxhash64(key, text).alias("_row"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = whole.filter("_key IS NOT NULL")
    if length < LONG:
        long = repeated_ranges([(keyed, None)], LONG, LONG_PREFIX, False, bucket, hot)
        settled = bloom.shared(long.select("_row"))
        tables = [(cut_lineage(with_ranges(keyed, long, settled)[0]), None), (keyed, settled)]
        ranges = long.unionByName(repeated_ranges(tables, length, prefix, True, bucket, hot))
    else:
        ranges = repeated_ranges([(keyed, None)], length, prefix, True, bucket, hot)
    touched, plain = with_ranges(whole, ranges, bloom.shared(ranges.select("_row")))
    schema = f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    changed = touched.select("_key", "text", "starts", "ends").mapInArrow(_cut, schema)
    same = plain.select(
        "_key", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
    return changed.unionByName(same).withColumnRenamed("_key", key)


def with_ranges(rows: DataFrame, ranges: DataFrame, shared) -> tuple[DataFrame, DataFrame]:
    """The rows that may have ranges, by a shared bitmap of _row, with their ranges, and the others with none. Only the
    former are shuffled."""
    lists = ranges.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("_r")) \
        .select("_row", F.col("_r.start").alias("starts"), F.col("_r.end").alias("ends"))
    none = F.array().cast("array<bigint>")
    maybe, plain = bloom.split(rows, F.col("_row"), shared)
    known = maybe.join(lists, "_row", "left") \
        .withColumn("starts", F.coalesce("starts", none)).withColumn("ends", F.coalesce("ends", none))
    return known, plain.withColumn("starts", none).withColumn("ends", none)

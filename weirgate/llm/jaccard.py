"""N-gram Jaccard join over count vectors: cells, an R-tree in each, overlap bounds, exact checks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm import bloom
from weirgate.llm.graph import components
from weirgate.llm.text import distinct_sorted, mix, rows_of, shingles, word_hashes
from weirgate.workspace import broadcast_if_small, cut_lineage, discard

#: Coordinates of a count vector, rows of an R-tree leaf, rows of a cell that one task searches at once.
GROUPS, LEAF, TILE = 512, 32, 2_000
#: Rows of small cells that one task searches, and pairs found there before repeated ones are merged.
BUCKET, GATHERED = 20_000, 1 << 19
#: log2 of the most counters of shingles, counters per set below that, counters that one row carries.
COUNTERS, ROOM, SLICE = 20, 16, 1 << 14


class Threshold:
    """Two sets link when ``whole`` * intersection >= ``part`` * union; all bounds are whole numbers."""

    def __init__(self, part: int, whole: int = 100):
        self.part, self.whole = part, whole

    def largest_partner(self, n):
        return n * self.whole // self.part

    def differing(self, total):
        """Most elements in one set only, given the sum of both sizes."""
        return total * (self.whole - self.part) // (self.whole + self.part)

    def leading(self, n):
        """Of n ordered elements so many first ones that the rest is too small for a link."""
        return n + 1 + -n * self.part // self.whole

    def overlap(self, total):
        """Least intersection, given the sum of both sizes."""
        return -(-total * self.part // (self.whole + self.part))


def counter_of(hashes: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each shingle; ``counters`` is a power of two."""
    return (hashes >> np.uint64(64 - (counters.bit_length() - 1))).astype(np.int64)


def cell_keys(sets: np.ndarray, counts: np.ndarray, limit: Threshold, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cells of each set (hashes ascending within a row): its rarest shingles.

    All shingles have one order, that of the level of their counter and then of their hash. Linked sets have so many
    shingles in common that the first of these in that order is among the first ``leading`` ones of both sets, whatever the
    levels are. True counts only keep shingles of many sets from being cells.
    """
    open_to_others = limit.differing(counts + limit.largest_partner(counts)) > 0
    wanted = np.where(open_to_others, limit.leading(counts), 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(owner * 256 + levels[counter_of(sets, len(levels))], kind="stable")
    place = np.arange(len(sets)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = place < wanted[owner]
    return owner[first], sets[order[first]]


def points(sets: np.ndarray, counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many elements of each set fall into each hash group, up to a byte's worth; what is above counts as excess."""
    owner = np.repeat(np.arange(len(counts)), counts)
    place = owner * groups + (sets % np.uint64(groups)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=len(counts) * groups), 255).astype(np.uint8).reshape(len(counts), groups)


def excess(vectors: np.ndarray, n: np.ndarray) -> np.ndarray:
    return n - vectors.sum(1, dtype=np.int64)


def may_link(x: np.ndarray, y: np.ndarray, n_x, n_y, over_x, over_y, limit: Threshold) -> np.ndarray:
    """Whether the summed coordinate minima, an upper bound of the overlap, reach what a link needs."""
    return np.minimum(x, y).sum(-1, dtype=np.int64) + np.minimum(over_x, over_y) >= limit.overlap(n_x + n_y)


def _row_sets(batch: pa.RecordBatch, width: int):
    """Per block of rows: its rows, distinct shingle hashes and set sizes."""
    for first, last, data, starts in rows_of(batch):
        made, counts = shingles(*word_hashes(data, starts), width)
        sets, sizes = distinct_sorted(made, counts)
        yield first, last, sets, sizes


def _named(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    digests = []
    for salt in (0x51ED270B0A1F7F65, 0xC6A4A7935BD1E995):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt)))])
        digests.append(mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return digests[0], digests[1]


def _slim(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets, sizes in _row_sets(batch, width):
                name, check = _named(sets, sizes)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                    pa.array(sizes.astype(np.int64)), pa.array(name), pa.array(check),
                ], ["_key", "_row", "n", "node", "check"])

    return run


def _hit(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that may be wanted."""
    for batch in batches:
        hit = bloom.holds(bitmap, batch.column("_row").to_numpy(zero_copy_only=False).view(np.uint64))
        if hit.any():
            yield batch.filter(pa.array(hit))


def _counted(width: int, shared, counters: int):
    """How many rows of a task hold a shingle, by counter up to a byte's worth, in packed slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.uint32)
        for batch in _hit(batches, shared.value):
            for _, _, sets, _ in _row_sets(batch, width):
                np.add.at(counts, counter_of(sets, counters), np.uint32(1))
        counts = np.minimum(counts, 255, out=counts).astype(np.uint8).reshape(-1, min(SLICE, counters))
        for k in np.flatnonzero(counts.any(1)).tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int64()), pa.array([zlib.compress(counts[k].tobytes(), 1)], pa.binary())], ["slice", "bytes"])

    return run


def _levels_of_slice(keys, rows: pd.DataFrame) -> pd.DataFrame:
    counts = 0
    for packed in rows["bytes"]:
        counts = counts + np.frombuffer(zlib.decompress(packed), np.uint8).astype(np.uint32)
    return pd.DataFrame({"slice": [int(keys[0])], "bytes": [np.floor(8 * np.log2(counts + 1.0)).astype(np.uint8).tobytes()]})


def _levels(docs: DataFrame, reps: DataFrame, bitmap, width: int) -> np.ndarray:
    """How common shingles are among the sets, in eighths of a doubling, by counter."""
    counters = 1 << min(COUNTERS, max(10, (reps.count() * ROOM).bit_length()))
    parts = docs.mapInArrow(_counted(width, bitmap, counters), "slice long, bytes binary") \
        .groupBy("slice").applyInPandas(_levels_of_slice, "slice long, bytes binary").collect()
    levels = np.zeros(counters, np.uint8)
    for part in parts:
        at = part["slice"] * SLICE
        levels[at:at + len(part["bytes"])] = np.frombuffer(part["bytes"], np.uint8)
    return levels


def _celled(width: int, limit: Threshold, shared, shared_levels):
    """Names and cells of the rows that may be wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _hit(batches, shared.value):
            for first, last, sets, sizes in _row_sets(batch, width):
                rows, keys = cell_keys(sets, sizes, limit, shared_levels.value)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=last - first))]).astype(np.int32)
                name, check = _named(sets, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), pa.array(check), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.view(np.int64)))],
                    ["node", "check", "cells"])

    return run


def _cells(docs: DataFrame, reps: DataFrame, width: int, limit: Threshold) -> DataFrame:
    """(node, check, cells) of the sets, with the names that their digests give, and few of them repeated."""
    context = docs.sparkSession.sparkContext
    docs = docs.select("_row", "text")
    bitmap = context.broadcast(bloom.build(reps, "_row"))
    levels = context.broadcast(_levels(docs, reps, bitmap, width))
    cells = cut_lineage(docs.mapInArrow(_celled(width, limit, bitmap, levels), "node long, check long, cells array<long>"))
    bitmap.destroy()
    levels.destroy()
    return cells


def _wanted(width: int, shared, whole: bool):
    """Of the rows that may be wanted the sets themselves, or else their count vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _hit(batches, shared.value):
            for first, last, sets, sizes in _row_sets(batch, width):
                if whole:
                    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(sets.view(np.int64)))
                else:
                    values = pa.array([p.tobytes() for p in points(sets, sizes)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, last - first), pa.array(sizes.astype(np.int64)), values], ["_row", "n", "value"])

    return run


def _values(nodes: DataFrame, reps: DataFrame, docs: DataFrame, width: int, whole: bool) -> DataFrame:
    """(node, n, value) of the nodes, read from their representatives' texts again: few rows move, no whole corpus of sets."""
    wanted = cut_lineage(reps.join(nodes.distinct(), "node", "left_semi").select("node", "_row"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "_row"))
    kind = "array<long>" if whole else "binary"
    found = docs.mapInArrow(_wanted(width, bitmap, whole), f"_row long, n long, value {kind}")
    values = cut_lineage(found.join(broadcast_if_small(wanted), "_row").dropDuplicates(["node"]).drop("_row"))
    bitmap.destroy()
    discard(wanted)
    return values


class RTree:
    """Boxes over count vectors, packed top down: each node halves its points along the coordinate that spreads most."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.points, self.n, self.over, self.nodes = points, n, excess(points, n), []
        if len(points):
            self._pack(np.arange(len(points)))

    def _pack(self, members: np.ndarray) -> int:
        own = self.points[members]
        node, high = len(self.nodes), own.max(0)
        self.nodes.append(None)
        spread = high - own.min(0)
        box = (high, int(self.n[members].min()), int(self.over[members].max()))
        if len(members) <= LEAF or not spread.any():
            self.nodes[node] = (*box, members, None)
            return node
        order = members[np.argsort(own[:, spread.argmax()], kind="stable")]
        half = len(order) // 2
        self.nodes[node] = (*box, None, (self._pack(order[:half]), self._pack(order[half:])))
        return node

    def pairs(self, limit: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points that may link: the overlap is at most the sum of coordinate minima, for boxes those of
        their upper corners."""
        stack = [(0, 0)] if self.nodes else []
        while stack:
            a, b = stack.pop()
            high_a, least_a, over_a, members_a, below_a = self.nodes[a]
            high_b, least_b, over_b, members_b, below_b = self.nodes[b]
            if not may_link(high_a, high_b, least_a, least_b, over_a, over_b, limit):
                continue
            if below_a is None and below_b is None:
                for at in range(0, len(members_a), LEAF):  # equal points may make a leaf large
                    for to in range(0, len(members_b), 4 * LEAF):
                        x, y = members_a[at:at + LEAF, None], members_b[None, to:to + 4 * LEAF]
                        i, j = np.nonzero(may_link(self.points[x], self.points[y], self.n[x], self.n[y], self.over[x], self.over[y], limit))
                        yield x[i, 0], y[0, j]
            elif a == b:
                left, right = below_a
                stack += [(left, left), (left, right), (right, right)]
            elif below_b is None or (below_a is not None and a < b):
                stack += [(below_a[0], b), (below_a[1], b)]
            else:
                stack += [(a, below_b[0]), (a, below_b[1])]


def _leaf_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each of many cells that are no larger than a leaf."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes).tolist():
        i, j = np.triu_indices(size, 1)
        first = starts[sizes == size][:, None]
        left.append((first + i).ravel())
        right.append((first + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs, taken in order, join parts that the pairs before them have not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(left), bool)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            keep[k] = True
    return keep


def _search(limit: Threshold, sparse: bool):
    """Pairs across components in the cells of a bucket whose count vectors allow a link.

    ``sparse`` keeps of them a forest that joins the same components, the likeliest pairs first.
    """
    def run(keys, rows: pd.DataFrame) -> pd.DataFrame:
        _, one, other = keys
        vectors = np.frombuffer(b"".join(rows["point"]), np.uint8).reshape(len(rows), -1)
        node, part, tile, n = (rows[c].to_numpy() for c in ("node", "part", "tile", "n"))
        own = np.repeat(np.arange(len(rows)), rows["cells"].map(len).to_numpy())  # the row that stands in each place of a cell
        cell = np.concatenate(rows["cells"].tolist())
        by = np.argsort(cell, kind="stable")
        cell, own = cell[by], own[by]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.append(starts, len(cell)))

        def across(i, j):
            """Pairs of different components; pairs within a tile belong to that tile's own search."""
            keep = part[i] != part[j]
            if one != other:
                keep &= tile[i] != tile[j]
            return i[keep], j[keep]

        def bounded(i, j):
            over = excess(vectors, n)
            for at in range(0, len(i), 1 << 14):
                x, y = i[at:at + (1 << 14)], j[at:at + (1 << 14)]
                may = may_link(vectors[x], vectors[y], n[x], n[y], over[x], over[y], limit)
                yield x[may], y[may]

        def distinct(i, j):
            """Copies meet in many cells."""
            pair = np.unique(np.minimum(i, j).astype(np.int64) * len(rows) + np.maximum(i, j))
            return pair // len(rows), pair % len(rows)

        def proposed():
            yield from bounded(*distinct(*across(*(own[x] for x in _leaf_pairs(starts[sizes <= LEAF], sizes[sizes <= LEAF])))))
            for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
                held = own[start:start + size]
                for i, j in RTree(vectors[held], n[held]).pairs(limit):
                    yield across(held[i], held[j])

        def merged(found):
            """The pairs without repeated ones. What a forest leaves out, it leaves out with more pairs as well."""
            i, j = distinct(*(np.concatenate(x) for x in zip(*found)))
            if sparse and len(i):
                shared = [np.minimum(vectors[i[at:at + (1 << 14)]], vectors[j[at:at + (1 << 14)]]).sum(1, dtype=np.int64)
                          for at in range(0, len(i), 1 << 14)]
                by = np.argsort(limit.overlap(n[i] + n[j]) - np.concatenate(shared), kind="stable")
                i, j = i[by], j[by]
                keep = _forest(part[i], part[j])
                i, j = i[keep], j[keep]
            return i, j

        found, fresh = [(np.zeros(0, np.int64),) * 2], 0
        for i, j in proposed():
            found.append((i, j))
            fresh += len(i)
            if fresh >= max(GATHERED, len(found[0][0])):
                found, fresh = [merged(found)], 0
        i, j = merged(found)
        return pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])}).drop_duplicates()

    return run


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, limit: Threshold) -> DataFrame:
    """The pairs ``a``, ``b`` (a written table, deleted here) whose sets link."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = _values(nodes, reps, docs, width, True)
    one = sets.select(F.col("node").alias("a"), F.col("value").alias("_x"))
    two = sets.select(F.col("node").alias("b"), F.col("value").alias("_y"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("_x", "_y"))
    linked = cut_lineage(both.filter(
        limit.whole * common >= limit.part * (F.size("_x") + F.size("_y") - common)).select("a", "b"))
    discard(sets, pairs)
    return linked


def _bounded(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs whose count vectors allow a link."""
    @F.pandas_udf("boolean")
    def allowed(x: pd.Series, y: pd.Series, n_x: pd.Series, n_y: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
        n, m = n_x.to_numpy(), n_y.to_numpy()
        return pd.Series(may_link(a, b, n, m, excess(a, n), excess(b, m), limit))

    one = sets.select(F.col("node").alias("a"), F.col("value").alias("_x"), F.col("n").alias("_n"))
    two = sets.select(F.col("node").alias("b"), F.col("value").alias("_y"), F.col("n").alias("_m"))
    return pairs.join(one, "a").join(two, "b").filter(allowed("_x", "_y", "_n", "_m")).select("a", "b")


def _candidates(members: DataFrame, joined: DataFrame, vectors: DataFrame, limit: Threshold, tile: int, sparse: bool) -> DataFrame:
    """Pairs across components that meet in a cell and may link; small cells share a task, large ones are dealt out in tiles.

    Cells of the same sets propose the same pairs, so one of them stays: cells are compared by the sums of two 64-bit
    hashes of their sets. Small cells go to the task of their least set, where a set's cells share one copy of its vector.
    """
    placed = members.join(joined, "node", "left").withColumn("part", F.coalesce("component", "node")).select("cell", "node", "part")
    hashes = [F.xxhash64(F.lit(seed), "node") for seed in (1, 2)]
    halves = [half for h in hashes for half in (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]  # sums stay in 64 bits
    sums = [F.sum(half).alias(f"_sum{k}") for k, half in enumerate(halves)]
    open_cells = placed.groupBy("cell").agg(F.min("part").alias("_a"), F.max("part").alias("_b"), F.count("*").alias("_n"),
                                            F.min("node").alias("_low"), *sums).filter("_a <> _b") \
        .groupBy("_n", "_low", *[f"_sum{k}" for k in range(len(sums))]).agg(F.min("cell").alias("cell")) \
        .select("cell", "_low", F.ceil(F.col("_n") / tile).cast("int").alias("_tiles"))
    rest = cut_lineage(placed.join(open_cells, "cell"))
    own = F.pmod(F.xxhash64("node", "cell"), F.col("_tiles")).cast("int")
    dealt = rest.withColumn("tile", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))) \
        .withColumn("one", F.least("tile", "_with")).withColumn("other", F.greatest("tile", "_with"))
    small = F.pmod(F.xxhash64("_low"), F.lit(rest.count() // BUCKET + 1))
    gathered = dealt.withColumn("bucket", F.when(F.col("_tiles") > 1, F.col("cell")).otherwise(small)) \
        .groupBy("bucket", "one", "other", "node", "part", "tile").agg(F.collect_set("cell").alias("cells"))
    found = gathered.join(vectors.withColumnRenamed("value", "point"), "node") \
        .groupBy("bucket", "one", "other").applyInPandas(_search(limit, sparse), "a long, b long")
    pairs = cut_lineage(found.distinct())
    discard(rest)
    return pairs


def link(
    docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text", tile: int = TILE,
) -> DataFrame:
    """Classes of rows linked by the Jaccard similarity of their sets of word shingles.

    Words are runs of non-whitespace with A-Z lowered; a set holds the distinct shingles of ``width`` words, of a
    shorter text the whole sequence. Sets link when 100 * intersection >= ``percent`` * union. Returns per row ``key``,
    n_shingles, component_id: the smallest key reachable by links. Null, empty and blank texts have 0 shingles and
    are their own component; a null key never names a component, but passes links on. Equal sets, repeated rows
    included, collapse to one before the search. An empty table gives no rows; other columns are ignored.

    Steps: (1) each set becomes a digest, and its rarest shingles, as counted over all sets, become its cells; (2) cells held by
    two or more different sets remain, and their sets get count vectors; (3) each set is checked against the least set of one of its
    cells, and the links found already join most copies; (4) cells that still hold several components are searched by an
    R-tree, large cells in tiles, for pairs across components whose overlap bound allows a link: first for a forest of the
    likeliest, then, components having grown, for all that are left; (5) those are checked. A link that is not checked joins
    sets that are in one component anyway. Tables between the steps are deleted once read for the last time.
    """
    limit = Threshold(percent)
    kind = docs.schema[key].dataType.simpleString()
    whole = docs.select(F.col(key).alias("_key"), F.xxhash64(key, text).alias("_row"), F.col(text).alias("text"))
    slim = cut_lineage(whole.mapInArrow(_slim(width), f"_key {kind}, _row long, n long, node long, check long"))
    clash = slim.groupBy("node").agg(F.min("check").alias("_a"), F.max("check").alias("_b")).filter("_a <> _b").select("node")
    clashing = not clash.isEmpty()
    if clashing:  # two sets share a digest: name those by both digests
        clash = cut_lineage(clash.withColumn("_clash", F.lit(True)))

    def told_apart(named: DataFrame) -> DataFrame:
        if not clashing:
            return named
        renamed = F.xxhash64("node", "check")
        return named.join(clash, "node", "left") \
            .withColumn("node", F.when(F.col("_clash"), renamed).otherwise(F.col("node"))).drop("_clash")

    slim = cut_lineage(told_apart(slim)) if clashing else slim
    filled = slim.filter("n > 0")
    reps = cut_lineage(filled.groupBy("node").agg(F.first("_row").alias("_row")))

    celled = _cells(whole, reps, width, limit)
    cells = told_apart(celled).select("node", F.explode("cells").alias("cell"))
    shared = cut_lineage(cells.groupBy("cell").agg(F.min("node").alias("low"), F.max("node").alias("_high"))
                         .filter("low < _high").drop("_high"))
    held, _ = bloom.split(cells, F.col("cell"), bloom.shared(shared.select("cell")))
    members = cut_lineage(held.join(shared, "cell").dropDuplicates(["cell", "node"]))
    discard(celled, shared)

    stars = members.filter("node <> low").groupBy("node").agg(F.min("low").alias("a")).select("a", F.col("node").alias("b"))
    vectors = _values(members.select("node"), reps, whole, width, False)
    links = _verified(cut_lineage(_bounded(stars, vectors, limit)), reps, whole, width, limit)
    joined = cut_lineage(components(links))
    for sparse in (True, False):
        more = _verified(_candidates(members, joined, vectors, limit, tile, sparse), reps, whole, width, limit)
        if not more.isEmpty():
            before, links = (links, more, joined), cut_lineage(links.union(more))
            joined = cut_lineage(components(links))
            discard(*before)
    discard(members, vectors, reps, links)

    member = filled.select("_key", "n", "node").join(joined, "node", "left") \
        .select("_key", "n", F.coalesce("component", "node").alias("_part"))
    labels = cut_lineage(member.groupBy("_part").agg(F.min("_key").alias("component_id")))
    linked = member.join(labels, "_part").select("_key", "n", "component_id")
    alone = slim.filter("n = 0").select("_key", "n", F.col("_key").alias("component_id"))
    return linked.union(alone).select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), "component_id")

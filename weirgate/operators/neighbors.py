"""Exact k nearest neighbours.

Two ways give the same answer:

* the reference side is small (row and size bound checked): it is broadcast, and
  each Arrow batch of queries is compared with it in the task;
* it is not: both sides are partitioned around pivot points. A query first visits
  its home cell, which bounds its k-th distance; then it visits only those cells
  the triangle inequality cannot rule out. Cells are cut into blocks of bounded
  size on both sides, so a dense cell is spread over many tasks, and each block
  pair returns at most k rows per query.

Order is (distance, id), so ties go to the lower id.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.operators.sampling import row_cap
from weirgate.workspace import cut_lineage, join_hot

NEIGHBORS = "array<struct<distance: double, id: bigint, label: int>>"
BROADCAST_ROWS = 100_000
BROADCAST_CELLS = 8_000_000
CELL_ROWS = 20_000
MAX_CELLS = 4_096
BLOCK_ROWS = 20_000
# Distances per tile: small enough to stay in cache.
TILE = 128_000

# The batch functions travel to the executors by value, so these need not have
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(vectors) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _distances(q: np.ndarray, t: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distance for p = 1 or 2, summed column by column in order."""
    total = np.zeros((len(q), len(t)))
    for j in range(t.shape[1]):
        diff = q[:, j, None] - t[None, :, j]
        total += np.abs(diff, out=diff) if p == 1 else np.multiply(diff, diff, out=diff)
    return total if p == 1 else np.sqrt(total)


def _nearest(q: np.ndarray, t: np.ndarray, k: int, p: int):
    """(row, column, distance) of the k nearest columns of every row; columns are sorted by id."""
    k = min(k, len(t))
    rows, cols, dist = [], [], []
    step = max(1, TILE // max(len(t), 1))
    for start in range(0, len(q), step):
        d = _distances(q[start:start + step], t, p)
        limit = np.partition(d, k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero(d <= limit[:, None])
        v = d[r, c]
        order = np.lexsort((c, v, r))
        r, c, v = r[order], c[order], v[order]
        first = np.searchsorted(r, np.arange(len(d)))
        top = np.arange(len(r)) - first[r] < k
        rows.append(r[top] + start)
        cols.append(c[top])
        dist.append(v[top])
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def share_if_small(reference: DataFrame, rows: int = BROADCAST_ROWS) -> Broadcast | None:
    """``reference`` (id, label, x) sorted by id and broadcast, or None if it passes a bound.

    The size is taken first, over at most one row more than the bound.
    """
    size = reference.limit(rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    if size["n"] > rows or size["n"] * (size["width"] or 0) > BROADCAST_CELLS:
        return None
    table = reference.select("id", "label", "x").toArrow().combine_chunks()
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    labels = table["label"].to_numpy().astype("int32")
    matrix = np.ascontiguousarray(_matrix(table["x"])[order])
    return reference.sparkSession.sparkContext.broadcast((ids[order], labels[order], matrix))


def neighbors_column(x: Column, shared: Broadcast, k: int, p: int = 2) -> Column:
    """Neighbours of the array column ``x`` in a shared reference side. Stream-safe."""

    @F.arrow_udf(NEIGHBORS)
    def search(vectors: pa.Array) -> pa.Array:
        ids, labels, matrix = shared.value
        rows, cols, dist = _nearest(_matrix(vectors), matrix, k, p)
        offsets = np.searchsorted(rows, np.arange(len(vectors) + 1)).astype("int32")
        items = pa.StructArray.from_arrays(
            [pa.array(dist, pa.float64()), pa.array(ids[cols], pa.int64()), pa.array(labels[cols], pa.int32())],
            names=["distance", "id", "label"],
        )
        return pa.ListArray.from_arrays(pa.array(offsets), items)

    return search(x)


def with_neighbors(
    queries: DataFrame, reference: DataFrame, k: int, p: int = 2, id_col: str = "id",
    shared: Broadcast | None = None, broadcast_rows: int = BROADCAST_ROWS,
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``queries`` plus ``neighbors``, the k nearest rows of ``reference`` (id, label, x).

    ``queries`` holds ``id_col`` and the array ``x``. ``shared`` reuses a reference
    side already broadcast. The partitioned way joins its answer back on the id.
    """
    shared = shared or share_if_small(reference, broadcast_rows)
    if shared is not None:
        return queries.withColumn("neighbors", neighbors_column(F.col("x"), shared, k, p))
    asked = queries.select(F.col(id_col).alias("id"), "x")
    found = _partitioned(asked, reference, k, p, cell_rows, block_rows)
    return queries.join(found.withColumnRenamed("id", id_col), id_col, "left")


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """n integer lists from (row, value) pairs ordered by row."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _pick_first(q: np.ndarray, centres: np.ndarray, sizes: np.ndarray, k: int, p: int) -> pa.Array:
    """Per query, the nearest cells that together hold at least k rows."""
    rows, cols = [], []
    step = max(1, TILE // len(centres))
    for start in range(0, len(q), step):
        order = np.argsort(_distances(q[start:start + step], centres, p), axis=1, kind="stable")
        held = sizes[order]
        before = np.cumsum(held, axis=1) - held
        r, c = np.nonzero((before < k) & (held > 0))
        rows.append(r + start)
        cols.append(order[r, c])
    return _lists(np.concatenate(rows), np.concatenate(cols), len(q)) if rows else _lists(np.zeros(0), np.zeros(0), 0)


def _pick_rest(q, centres, sizes, radii, bound, k, p) -> pa.Array:
    """Per query, the further cells that may hold a row at most ``bound`` away."""
    rows, cols = [], []
    step = max(1, TILE // len(centres))
    for start in range(0, len(q), step):
        d = _distances(q[start:start + step], centres, p)
        order = np.argsort(d, axis=1, kind="stable")
        held = sizes[order]
        before = np.cumsum(held, axis=1) - held
        limit = bound[start:start + step] * (1 + 1e-9) + 1e-12
        reach = np.take_along_axis(d, order, axis=1) - radii[order] <= limit[:, None]
        r, c = np.nonzero(reach & (before >= k) & (held > 0))
        rows.append(r + start)
        cols.append(order[r, c])
    return _lists(np.concatenate(rows), np.concatenate(cols), len(q)) if rows else _lists(np.zeros(0), np.zeros(0), 0)


def _partitioned(queries, reference, k, p, cell_rows, block_rows) -> DataFrame:
    spark = reference.sparkSession
    # Of equal points only the k lowest ids can ever be chosen, and equal queries
    # have one answer: copies collapse on both sides before any comparison.
    rank = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    reference = reference.select("id", "label", "x").withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
    asked = cut_lineage(queries.select("id", "x"))
    points = asked.groupBy("x").agg(F.min("id").alias("id"))
    reference = cut_lineage(reference)
    n = reference.count()
    n_cells = max(1, min(MAX_CELLS, math.ceil(n / cell_rows)))
    # At most MAX_CELLS pivots come to the driver.
    pivots = row_cap(reference, n_cells, "id", seed=7).orderBy("id").select("x").toArrow()["x"]
    centres = spark.sparkContext.broadcast(np.ascontiguousarray(_matrix(pivots)))

    @F.arrow_udf("struct<cell: int, away: double>")
    def home(vectors: pa.Array) -> pa.Array:
        _, cols, dist = _nearest(_matrix(vectors), centres.value, 1, p)
        return pa.StructArray.from_arrays(
            [pa.array(cols, pa.int32()), pa.array(dist, pa.float64())], names=["cell", "away"])

    placed = cut_lineage(reference.withColumn("h", home("x")).select("id", "label", "x", "h.cell", "h.away"))
    # One row per pivot, so at most MAX_CELLS rows come back.
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    sizes, radii = np.zeros(len(pivots), dtype="int64"), np.zeros(len(pivots))
    for r in stats:
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    cells = spark.sparkContext.broadcast((sizes, radii))

    @F.arrow_udf("array<int>")
    def first_cells(vectors: pa.Array) -> pa.Array:
        return _pick_first(_matrix(vectors), centres.value, cells.value[0], k, p)

    @F.arrow_udf("array<int>")
    def other_cells(vectors: pa.Array, bound: pa.Array) -> pa.Array:
        return _pick_rest(_matrix(vectors), centres.value, *cells.value, bound.to_numpy(zero_copy_only=False), k, p)

    started = cut_lineage(points.withColumn("cells", first_cells("x")))
    found = _visit(started, placed, sizes, k, p, block_rows)
    first = cut_lineage(
        started.select("id", "x").join(_merge(found, k), "id")
        .withColumn("bound", F.element_at("neighbors", -1)["distance"])
    )
    second = cut_lineage(first.select("id", "x", other_cells("x", "bound").alias("cells")))
    more = _visit(second, placed, sizes, k, p, block_rows)
    kept = first.select("id", F.inline("neighbors").alias("distance", "nid", "label"))
    answers = _merge(kept.unionByName(more), k)
    by_point = cut_lineage(started.select("id", "x").join(answers, "id").select("x", "neighbors"))
    return join_hot(asked, by_point, "x", asked.count()).select("id", "neighbors")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """k best per query; each block a query visited contributes at most k rows."""
    item = F.struct("distance", F.col("nid").alias("id"), "label")
    return found.groupBy("id").agg(
        F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("neighbors"))


def _visit(queries: DataFrame, placed: DataFrame, sizes: np.ndarray, k: int, p: int, block_rows: int) -> DataFrame:
    """Compare queries (id, x, cells) with the rows of the cells they visit, block by block."""
    spark = queries.sparkSession
    visits = queries.select("id", "x", F.explode("cells").alias("cell"))
    # Counts per pivot cell: at most MAX_CELLS rows.
    load = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    plan = spark.createDataFrame(
        [(int(c), max(1, math.ceil(int(sizes[c]) / block_rows)), math.ceil(m / block_rows))
         for c, m in load.items()],
        "cell int, blocks int, chunks int",
    )
    keyed_queries = (
        visits.join(F.broadcast(plan), "cell")
        .withColumn("chunk", F.pmod(F.hash("id"), F.col("chunks")))
        .select("id", "x", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    )
    keyed_rows = (
        placed.join(F.broadcast(plan), "cell")
        .withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
        .select("id", "label", "x", "cell", "block",
                F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["id"].to_numpy(), kind="stable") if right.num_rows else np.zeros(0, int)
        if left.num_rows and right.num_rows:
            rows, cols, dist = _nearest(_matrix(left["x"]), _matrix(right["x"])[order], k, p)
        else:
            rows, cols, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return pa.table({
            "id": pa.array(left["id"].to_numpy()[rows], pa.int64()),
            "distance": pa.array(dist, pa.float64()),
            "nid": pa.array(right["id"].to_numpy()[order][cols], pa.int64()),
            "label": pa.array(right["label"].to_numpy()[order][cols], pa.int32()),
        })

    keys = ["cell", "block", "chunk"]
    return (
        keyed_queries.groupBy(*keys).cogroup(keyed_rows.groupBy(*keys))
        .applyInArrow(compare, "id bigint, distance double, nid bigint, label int")
    )

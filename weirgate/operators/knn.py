"""k-nearest-neighbour classifier on exact neighbours."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.operators.neighbors import share_if_small, with_neighbors
from weirgate.operators.sampling import stratified_fold
from weirgate.workspace import cut_lineage

# The two search grids, offline and live.
OFFLINE_GRID = {"k": [3, 5, 7, 10], "weights": ["uniform", "distance"], "p": [1, 2]}
LIVE_GRID = {"k": [3, 5, 7], "weights": ["uniform", "distance"], "p": [1, 2]}


def vote(neighbors: Column, k: int, weights: str, labels: list[int]) -> Column:
    """Class with the largest weight among the first k; the lower class wins a tie.

    With distance weights a neighbour at distance 0 silences all others.
    """
    near = F.slice(neighbors, 1, k)
    exact = F.exists(near, lambda n: n["distance"] == 0)

    def weight(n):
        if weights == "uniform":
            return F.lit(1.0)
        return F.when(exact, (n["distance"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), n["distance"]))

    def total(c: int) -> Column:
        own = F.filter(near, lambda n: n["label"] == c)
        return F.aggregate(own, F.lit(0.0), lambda a, n: a + weight(n))

    totals = [total(c) for c in sorted(labels)]
    best = F.greatest(*totals) if len(totals) > 1 else totals[0]
    out = F
    for c, t in zip(sorted(labels), totals):
        out = out.when(t == best, F.lit(c))
    return out.otherwise(F.lit(None)).cast("int")


@dataclass
class KnnModel:
    """The training rows (id, label, x) and the chosen settings."""

    train: DataFrame
    labels: list[int]
    k: int = 5
    weights: str = "uniform"
    p: int = 2
    _shared: Broadcast | None = field(default=None, repr=False, compare=False)

    def transform(self, df: DataFrame, id_col: str = "flow_id", output: str = "prediction") -> DataFrame:
        """Add the predicted class. ``df`` holds the feature array ``x``.

        A small training side is broadcast and read by a column expression (also
        on streams); a large one goes through the partitioned search.
        """
        # Broadcast once, not once per micro-batch.
        self._shared = self._shared or share_if_small(self.train)
        numbered = self._shared is None and id_col not in df.columns
        if numbered:  # the partitioned search joins its answer back on an id, which must not change in between
            df, id_col = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id())), "_row"
        near = with_neighbors(df, self.train, self.k, self.p, id_col, self._shared)
        return near.withColumn(output, vote(F.col("neighbors"), self.k, self.weights, self.labels)).drop("neighbors", *["_row"] * numbered)


def training_rows(df: DataFrame, id_col: str = "flow_id", label: str = "label") -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"), "x")


def class_labels(train: DataFrame) -> list[int]:
    return sorted(r[0] for r in train.select("label").distinct().collect())


def grid_search(train: DataFrame, grid: dict | None = None, folds: int = 5, seed: int = 42) -> DataFrame:
    """Cross-validated accuracy of every candidate (p, k, weights) over stratified folds, best first.

    Neighbours are searched once per fold and p with the largest k; all k and
    weights read their vote from that one list.
    """
    grid = LIVE_GRID if grid is None else grid
    labels = class_labels(train)
    rows = cut_lineage(stratified_fold(train, folds, id_col="id", seed=seed))
    candidates = list(product(grid["k"], grid["weights"]))
    votes = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(w).alias("weights"),
                 vote(F.col("neighbors"), k, w, labels).alias("prediction"))
        for k, w in candidates
    ])
    searched = None
    for f in range(folds):
        test, rest = rows.filter(F.col("fold") == f), rows.filter(F.col("fold") != f).drop("fold")
        shared = share_if_small(rest)
        for p in grid["p"]:
            near = with_neighbors(test, rest, max(grid["k"]), p, shared=shared).select(
                F.lit(p).alias("p"), "fold", F.col("label").alias("y"), "neighbors")
            searched = near if searched is None else searched.unionByName(near)
    hit = (F.col("y") == F.col("prediction")).cast("double")
    return (
        searched.select("p", "fold", "y", F.inline(votes)).groupBy("p", "k", "weights", "fold").agg(F.avg(hit).alias("accuracy"))
        .groupBy("p", "k", "weights").agg(F.avg("accuracy").alias("accuracy"))
        .orderBy(F.desc("accuracy"), "k", "p", F.desc("weights"))
    )


def fit(train: DataFrame, grid: dict | None = None, folds: int = 5, seed: int = 42) -> KnnModel:
    best = grid_search(train, grid, folds, seed).first()
    return KnnModel(train, class_labels(train), best["k"], best["weights"], best["p"])

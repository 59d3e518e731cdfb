"""Gaussian naive Bayes as class moments and one likelihood expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.operators.sampling import stratified_fold
from weirgate.workspace import cut_lineage

# Smoothing candidates.
SMOOTHING_GRID = [1e-9, 1e-8, 1e-7, 1e-6, 1e-5]


@dataclass
class ClassMoments:
    n: float
    means: list[float]
    variances: list[float]

    def minus(self, other: "ClassMoments") -> "ClassMoments":
        """Moments of the rows that are in this set but not in ``other``."""
        n = self.n - other.n
        if n <= 0:
            return ClassMoments(0, [], [])
        means, variances = [], []
        for m, v, om, ov in zip(self.means, self.variances, other.means, other.variances):
            mean = (self.n * m - other.n * om) / n
            square = (self.n * (v + m * m) - other.n * (ov + om * om)) / n
            means.append(mean)
            variances.append(max(square - mean * mean, 0.0))
        return ClassMoments(n, means, variances)


def _pool(parts: list[ClassMoments]) -> list[float]:
    """Variance per feature over all classes together."""
    n = sum(c.n for c in parts)
    out = []
    for j in range(len(parts[0].means)):
        mean = sum(c.n * c.means[j] for c in parts) / n
        out.append(sum(c.n * (c.variances[j] + (c.means[j] - mean) ** 2) for c in parts) / n)
    return out


def _moments(df: DataFrame, keys: list[str], width: int) -> list[tuple[tuple, ClassMoments]]:
    cells = [F.element_at("x", j + 1) for j in range(width)]
    rows = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in cells]).alias("means"),
        F.array(*[F.var_pop(c) for c in cells]).alias("variances"),
    ).collect()
    return [
        (tuple(r[k] for k in keys), ClassMoments(float(r["n"]), list(r["means"]), list(r["variances"])))
        for r in rows
    ]


# Per class: label, log prior minus half the log determinant, means, variances.
PARAMETERS = "array<struct<c: int, constant: double, m: array<double>, v: array<double>>>"


def _parameters(classes: dict[int, ClassMoments], smoothing: float) -> list[tuple]:
    parts = {c: m for c, m in sorted(classes.items()) if m.n > 0}
    floor = smoothing * max(_pool(list(parts.values())), default=0.0)
    total = sum(m.n for m in parts.values())
    out = []
    for c, m in parts.items():
        variances = [max(v + floor, 1e-300) for v in m.variances]
        constant = math.log(m.n / total) - 0.5 * sum(math.log(2 * math.pi * v) for v in variances)
        out.append((c, constant, m.means, variances))
    return out


def _prediction(x: Column, parameters: Column) -> Column:
    """Class with the highest log-likelihood; the lower class wins a tie."""
    def score(q):
        spread = F.zip_with(
            x, F.arrays_zip(q["m"].alias("m"), q["v"].alias("v")),
            lambda a, p: (a - p["m"]) * (a - p["m"]) / p["v"])
        likelihood = q["constant"] - F.lit(0.5) * F.aggregate(spread, F.lit(0.0), lambda s, v: s + v)
        return F.struct(likelihood.alias("score"), (-q["c"]).alias("order"))

    return (-F.array_max(F.transform(parameters, score))["order"]).cast("int")


def _literal(parameters: list[tuple]) -> Column:
    return F.array(*[
        F.struct(F.lit(c).alias("c"), F.lit(k).alias("constant"),
                 F.array(*[F.lit(a) for a in m]).alias("m"), F.array(*[F.lit(a) for a in v]).alias("v"))
        for c, k, m, v in parameters
    ])


@dataclass
class GaussianNb:
    classes: dict[int, ClassMoments]
    smoothing: float = 1e-9

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, _prediction(F.col("x"), _literal(_parameters(self.classes, self.smoothing))))


def _width(df: DataFrame) -> int:
    row = df.select(F.size("x").alias("d")).first()
    if row is None:
        raise ValueError("no rows to train on")
    return row["d"]


def fit(df: DataFrame, label: str = "label", smoothing: float = 1e-9) -> GaussianNb:
    """One aggregation; the state is one row per class."""
    moments = _moments(df.filter(F.col(label).isNotNull()), [label], _width(df))
    return GaussianNb({key[0]: m for key, m in moments}, smoothing)


def grid_search(df: DataFrame, folds: int = 5, id_col: str = "flow_id", label: str = "label",
                grid: list[float] | None = None, seed: int = 42) -> list[tuple[float, float]]:
    """(smoothing, cross-validated accuracy), best first, in two passes over the data.

    The first pass takes moments per fold and class. The training moments of a
    fold are the total minus that fold, so no fold is aggregated twice. The
    second pass scores every candidate at once. Folds are stratified and written with the rows once.
    """
    grid = SMOOTHING_GRID if grid is None else grid
    rows = cut_lineage(stratified_fold(df.filter(F.col(label).isNotNull()), folds, label, id_col, seed))
    per_fold = dict(_moments(rows, ["fold", label], _width(df)))
    labels = sorted({c for _, c in per_fold})
    total: dict[int, ClassMoments] = {}
    for c in labels:
        parts = [m for (_, cls), m in per_fold.items() if cls == c]
        n = sum(m.n for m in parts)
        d = len(parts[0].means)
        means = [sum(m.n * m.means[j] for m in parts) / n for j in range(d)]
        variances = [
            sum(m.n * (m.variances[j] + (m.means[j] - means[j]) ** 2) for m in parts) / n for j in range(d)
        ]
        total[c] = ClassMoments(n, means, variances)
    # One row per fold holds all candidates, so the join multiplies no rows.
    table = []
    for f in range(folds):
        rest = {c: total[c].minus(per_fold[(f, c)]) if (f, c) in per_fold else total[c] for c in labels}
        table.append((f, [_parameters(rest, s) for s in grid]))
    candidates = df.sparkSession.createDataFrame(table, f"fold int, candidates array<{PARAMETERS}>")
    hits = [F.avg((F.col(label) == _prediction(F.col("x"), F.col("candidates")[i])).cast("double")) for i in range(len(grid))]
    per = rows.join(F.broadcast(candidates), "fold").groupBy("fold").agg(F.array(*hits).alias("hits")).collect()
    means = [math.fsum(r["hits"][i] for r in per) / len(per) for i in range(len(grid))]
    return sorted(((float(s), m) for s, m in zip(grid, means)), key=lambda t: (-t[1], t[0]))

"""Exact RBF support vector machine by a cascade: solve per group, pass support vectors on, until no row violates.

Each group's dual problem is solved to its optimality conditions by sequential minimal optimisation; rows without weight
drop out before groups are merged (a cascade as in Graf et al., 2004). Then the machine meets all rows, and those it
gets wrong join its support vectors, until none is left: then it is the machine of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.operators.svm import gamma_value
from weirgate.workspace import cut_lineage

#: Rows a machine may be fitted on, so that its support vectors can be sent to every task; more raise an error.
MAX_ROWS = 30_000
#: Rows of a first group, groups merged into one, bytes of kernel rows a task remembers, kernel cells computed at once.
GROUP_ROWS, MERGED, CACHE_BYTES, CELLS = 2_000, 4, 256 << 20, 1 << 21
WEIGHTED = "id bigint, x array<double>, y double, beta double, bias double"


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.exp(-gamma * np.maximum(squares, 0.0))


def solve(x: np.ndarray, y: np.ndarray, C: float, gamma: float, tol: float) -> tuple[np.ndarray, float]:
    """Signed dual weights and bias of one group: the largest violation of the optimality conditions is below ``tol``.

    Weights sum to zero and lie between 0 and C times the label. A step moves weight between the worst row and the
    partner that gains most, so each step raises the dual and the search ends. One class alone gives no weights.
    """
    beta, gap = np.zeros(len(y)), y.astype(float).copy()  # gap: label minus decision without bias
    least, most = np.minimum(0.0, C * y), np.maximum(0.0, C * y)
    rows: dict[int, np.ndarray] = {}
    room = max(2, CACHE_BYTES // (8 * max(1, len(y))))

    def row(i: int) -> np.ndarray:
        if i not in rows:
            if len(rows) >= room:
                del rows[next(iter(rows))]
            rows[i] = kernel(x[i:i + 1], x, gamma)[0]
        return rows[i]

    if len(np.unique(y)) < 2:
        return beta, float(y[0]) if len(y) else 0.0
    while True:
        up = np.where(beta < most, gap, -np.inf)
        down = np.where(beta > least, gap, np.inf)
        i = int(up.argmax())
        if up[i] - down.min() < tol:
            return beta, float(up[i] + down.min()) / 2
        own = row(i)
        bend = np.maximum(2 - 2 * own, 1e-12)
        j = int(np.where(down < up[i], (up[i] - down) ** 2 / bend, -1.0).argmax())
        step = min((up[i] - down[j]) / bend[j], most[i] - beta[i], beta[j] - least[j])
        beta[i] = most[i] if step == most[i] - beta[i] else beta[i] + step
        beta[j] = least[j] if step == beta[j] - least[j] else beta[j] - step
        gap -= step * (own - row(j))


@dataclass
class KernelMachine:
    """Support vectors with signed weights. ``rounds``: how often violators had to be taken in."""
    support: np.ndarray
    weights: np.ndarray
    bias: float
    gamma: float
    settings: dict
    rounds: int = 0
    _shared: Broadcast | None = field(default=None, repr=False, compare=False)

    @property
    def width(self) -> int:
        return self.support.shape[1]

    def decide(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        step = max(1, CELLS // max(1, len(self.support)))
        for low in range(0, len(x) if len(self.support) else 0, step):
            out[low:low + step] += kernel(x[low:low + step], self.support, self.gamma) @ self.weights
        return out

    def decision(self, df: DataFrame, output: str = "decision") -> DataFrame:
        """Add the distance to the border: positive for label 1."""
        plain = KernelMachine(self.support, self.weights, self.bias, self.gamma, {})
        shared, width = df.sparkSession.sparkContext.broadcast(plain), self.width

        @F.arrow_udf("double")
        def decide(x: pa.Array) -> pa.Array:
            return pa.array(shared.value.decide(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)))

        return df.withColumn(output, decide("x"))

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return self.decision(df, "_d").withColumn(output, (F.col("_d") > 0).cast("int")).drop("_d")


def _solved(rows: DataFrame, groups: int, C: float, gamma: float, tol: float) -> DataFrame:
    """The rows of each group that have weight; a group of one class passes all its rows on."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")  # the same steps whatever order rows arrive in
        x, y = np.stack(part["x"].to_numpy()), part["y"].to_numpy()
        beta, bias = solve(x, y, C, gamma, tol)
        part = part.assign(beta=beta, bias=bias)[["id", "x", "y", "beta", "bias"]]
        return part[beta != 0] if len(np.unique(y)) > 1 else part

    group = F.pmod(F.xxhash64("id"), F.lit(groups))
    return cut_lineage(rows.select("id", "x", "y", group.alias("_g")).groupBy("_g").applyInPandas(run, WEIGHTED))


def fit(df: DataFrame, C: float = 1.0, gamma: str | float = "scale", label: str = "label", id_col: str = "id",
        tol: float = 1e-3, max_rows: int = MAX_ROWS, group_rows: int = GROUP_ROWS) -> KernelMachine:
    """The exact machine of the rows, whose ids must be unique; ``label`` is 0 or 1, null labels are not read.

    When it returns, no row violates the optimality conditions by ``tol`` or more, whatever the groups were. Up to
    ``max_rows`` rows are taken; more, or none, raise ValueError. One class alone is always predicted.
    """
    rows = cut_lineage(df.filter(F.col(label).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), "x", F.when(F.col(label) > 0, 1.0).otherwise(-1.0).alias("y")))
    n = rows.count()
    if not 0 < n <= max_rows:
        raise ValueError(f"{n} rows to train on; at least one and at most {max_rows} are allowed")
    gamma_is, groups, kept = gamma_value(rows, gamma), -(-n // group_rows), rows
    while groups > 1:
        kept = _solved(kept, groups, C, gamma_is, tol)
        groups = -(-groups // MERGED)
    rounds = 0
    while True:
        kept = _solved(kept, 1, C, gamma_is, tol)
        found = kept.orderBy("id").collect()  # at most max_rows
        machine = KernelMachine(np.array([r["x"] for r in found]), np.array([r["beta"] for r in found]), found[0]["bias"],
                                gamma_is, {"C": C, "kernel": "rbf", "gamma": gamma, "rows": n}, rounds)
        unused = rows.join(F.broadcast(kept.select("id")), "id", "left_anti")
        wrong = machine.decision(unused).filter(F.col("y") * F.col("decision") <= 1 - tol).select("id", "x", "y")
        kept = cut_lineage(kept.select("id", "x", "y").unionByName(wrong))
        if kept.count() == len(found):
            return machine
        rounds += 1

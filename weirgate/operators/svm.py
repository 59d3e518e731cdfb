"""Support vector machines: linear on MLlib, RBF through random Fourier features.

The RBF kernel is approximated as in Rahimi and Recht (2007): cosines of fixed
Gaussian projections whose inner products approach the kernel, followed by the
distributed linear machine. ``dimension`` sets the quality; the seed fixes the
projections.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.operators.machines import Machine, Machines
from weirgate.operators.sampling import stratified_fold

# The offline grid and the live settings.
OFFLINE_GRID = {"C": [0.1, 1, 10, 100], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]}
LIVE = {"C": 1.0, "kernel": "rbf", "gamma": "scale"}
DIMENSION = 256


def gamma_value(df: DataFrame, gamma: str | float) -> float:
    """``auto`` = 1/d; ``scale`` = 1/(d · variance of all matrix entries)."""
    if not isinstance(gamma, str):
        return float(gamma)
    row = df.select(F.size("x").alias("d")).first()
    if row is None:
        raise ValueError("no rows to train on")
    width = row["d"]
    if gamma == "auto":
        return 1.0 / width
    # Sums of the row arrays: no explode, one aggregation.
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    m = df.agg((F.avg(total) / width).alias("m"), (F.avg(squares) / width).alias("s")).first()
    var = m["s"] - m["m"] ** 2
    return 1.0 / (width * var) if var > 0 else 1.0


@dataclass(frozen=True)
class FourierMap:
    """cos(x·W + b) with W ~ N(0, 2γ) and b ~ U(0, 2π), drawn from the seed."""

    width: int
    gamma: float
    dimension: int = DIMENSION
    seed: int = 42

    def lift(self) -> FourierLift:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0.0, np.sqrt(2.0 * self.gamma), (self.width, self.dimension))
        return FourierLift(w, rng.uniform(0.0, 2.0 * np.pi, self.dimension))

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        made = self.lift()

        @F.arrow_udf("array<double>")
        def lift(x: pa.Array) -> pa.Array:
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, self.width))
            z = made(rows)
            offsets = np.arange(len(x) + 1, dtype="int32") * z.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))

        return df.withColumn(output, array_to_vector(lift("x")))


@dataclass(frozen=True)
class FourierLift:
    """A map's projections, drawn."""

    w: np.ndarray
    b: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.b)) * np.cos(x @ self.w + self.b)


def plain(x: np.ndarray) -> np.ndarray:
    """The map of the linear kernel."""
    return x


@dataclass
class SvmModel:
    linear: LinearSVCModel
    fourier: FourierMap | None
    settings: dict

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        lifted = self.fourier.transform(df, "_z") if self.fourier else df.withColumn("_z", array_to_vector("x"))
        model = self.linear.setFeaturesCol("_z").setPredictionCol("_p").setRawPredictionCol("_raw")
        scored = model.transform(lifted)
        return scored.withColumn(output, F.col("_p").cast("int")).drop("_z", "_p", "_raw")


def fit(df: DataFrame, C: float = 1.0, kernel: str = "rbf", gamma: str | float = "scale",
        label: str = "label", dimension: int = DIMENSION, seed: int = 42, max_iter: int = 100, tol: float = 1e-4) -> SvmModel:
    """``df`` holds the feature array ``x`` and a 0/1 label."""
    rows = df.select("x", F.col(label).cast("double").alias("label")).filter("label IS NOT NULL")
    n = rows.count()
    if not n:
        raise ValueError("no rows to train on")
    fourier = None
    if kernel == "rbf":
        width = rows.select(F.size("x")).first()[0]
        fourier = FourierMap(width, gamma_value(rows, gamma), dimension, seed)
        rows = fourier.transform(rows)
    else:
        rows = rows.withColumn("features", array_to_vector("x"))
    rows = rows.select("features", "label")
    # The lifted features already share one scale; standardising them would
    # change the kernel.
    machine = LinearSVC(regParam=1.0 / (C * n), maxIter=max_iter, tol=tol, standardization=False,
                        featuresCol="features", labelCol="label")
    return SvmModel(machine.fit(rows), fourier, {"C": C, "kernel": kernel, "gamma": gamma})


def candidates(grid: dict | None = None) -> list[dict]:
    """Distinct settings; gamma plays no part in the linear kernel."""
    grid = OFFLINE_GRID if grid is None else grid
    out = []
    for kernel in grid["kernel"]:
        for c in grid["C"]:
            for g in grid["gamma"] if kernel == "rbf" else ["scale"]:
                out.append({"C": c, "kernel": kernel, "gamma": g})
    return out


def grid_search(df: DataFrame, folds: int = 5, grid: dict | None = None, id_col: str = "flow_id",
                label: str = "label", seed: int = 42, dimension: int = DIMENSION, max_steps: int = 1_000,
                tol: float = 1e-4) -> list[tuple[dict, float]]:
    """(settings, cross-validated accuracy), best first. The settings say how many ``steps`` the slowest fold took and
    whether all folds ``converged``.

    The machines of all settings and stratified folds are fitted in one loop: a step is one pass over the rows for all of them.
    """
    rows = df.select(id_col, "x", label).filter(F.col(label).isNotNull())
    rows = stratified_fold(rows, folds, label, id_col, seed)
    rows = rows.select("x", F.when(F.col(label) > 0, 1.0).otherwise(-1.0).alias("y"), "fold").persist()
    n = rows.count()
    if not n:
        raise ValueError("no rows to train on")
    width = rows.select(F.size("x")).first()[0]
    tried = candidates(grid)
    kernels = sorted({(c["kernel"], c["gamma"]) for c in tried}, key=str)
    lifts = [FourierMap(width, gamma_value(rows, gamma), dimension, seed).lift() if kernel == "rbf" else plain
             for kernel, gamma in kernels]
    train_rows = n * (folds - 1) / folds
    machines = Machines(rows, lifts, [
        Machine(kernels.index((c["kernel"], c["gamma"])), 1.0 / (c["C"] * train_rows), f) for c in tried for f in range(folds)])
    fitted = machines.fit(tol, max_steps)
    accuracies = machines.accuracies(fitted)
    machines.close()
    rows.unpersist()
    scores = []
    for i, c in enumerate(tried):
        own = slice(i * folds, (i + 1) * folds)
        found = [a for a in accuracies[own] if a is not None]
        told = {"steps": max(f.steps for f in fitted[own]), "converged": all(f.converged for f in fitted[own])}
        scores.append(({**c, **told}, math.fsum(found) / len(found)))
    return sorted(scores, key=lambda s: -s[1])

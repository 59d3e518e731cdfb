"""Machines fitted side by side, stratified folds."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from weirgate.operators import machines, sampling, svm
from weirgate.plans import training


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(a - b + rng.normal(0, .7) > 0), [float(a), float(b), float(c)])
            for i, (a, b, c) in enumerate(rng.normal(0, 1, (400, 3)))]
    return spark.createDataFrame(rows, "flow_id long, label int, x array<double>").persist()


def fitted(noisy, penalties, **options):
    rows = noisy.select("x", F.when(F.col("label") > 0, 1.0).otherwise(-1.0).alias("y"), (F.col("flow_id") % 3).cast("int").alias("fold"))
    held = [None, 0, 1]
    made = machines.Machines(rows, [svm.plain], [machines.Machine(0, p, h) for p in penalties for h in held], **options)
    return made, made.fit(1e-9)


def objective(x, y, w, penalty):
    return machines.rounded_hinge(y * (x @ w[:-1] + w[-1]))[0].mean() + penalty / 2 * w[:-1] @ w[:-1]


def test_machines_reach_the_least_loss(noisy):
    penalties = [1.0, 1e-2, 1e-4]
    made, found = fitted(noisy, penalties)
    assert all(f.converged for f in found)
    local = noisy.orderBy("flow_id").toPandas()
    x, y, fold = np.stack(local["x"]), np.where(local["label"] > 0, 1.0, -1.0), local["flow_id"].to_numpy() % 3
    rng = np.random.default_rng(1)
    for f, m in zip(found, made.machines):
        own = fold != (-1 if m.held is None else m.held)
        least = objective(x[own], y[own], f.weights, m.penalty)
        assert f.loss == pytest.approx(least)
        for scale in (1e-1, 1e-2, 1e-3):  # convex, so no better point nearby means none anywhere
            for step in rng.normal(0, scale, (200, 4)):
                assert objective(x[own], y[own], f.weights + step, m.penalty) >= least - 1e-7
    hits = made.accuracies(found)
    for f, m, hit in zip(found, made.machines, hits):
        rest = fold == m.held if m.held is not None else None
        assert hit is None if rest is None else hit == pytest.approx(
            ((x[rest] @ f.weights[:-1] + f.weights[-1] > 0) == (y[rest] > 0)).mean())


def test_sums_by_spark_equal_sums_on_the_driver(noisy):
    _, here = fitted(noisy, [1e-2])
    _, there = fitted(noisy.repartition(5), [1e-2], direct_tasks=1)
    for a, b in zip(here, there):
        assert np.allclose(a.weights, b.weights, atol=1e-3) and a.loss == pytest.approx(b.loss)


def test_machines_answer_like_the_library(noisy):
    _, found = fitted(noisy, [1e-2])
    library = LinearSVC(regParam=1e-2, maxIter=1_000, tol=1e-9, standardization=False).fit(training._vectors(noisy))
    x = np.stack(noisy.orderBy("flow_id").toPandas()["x"])
    theirs = x @ library.coefficients.toArray() + library.intercept > 0
    assert ((x @ found[0].weights[:-1] + found[0].weights[-1] > 0) == theirs).mean() >= 0.98


def test_stopped_machines_say_so(noisy):
    made, _ = fitted(noisy, [1e-2])
    assert not any(f.converged for f in made.fit(1e-9, max_steps=3))


def test_search_says_whether_it_converged(noisy):
    scores = svm.grid_search(noisy, 3, {"C": [0.1, 10], "kernel": ["linear"], "gamma": ["scale"]})
    assert all(s["converged"] and s["steps"] > 3 for s, _ in scores) and scores[0][1] >= 0.75
    with pytest.raises(ValueError, match="no rows"):
        svm.grid_search(noisy.filter("label > 5"), 3)


def test_stratified_folds(spark):
    rows = [(i, 0 if i % 50 else 1) for i in range(5_000)] + [(9_000 + i, None) for i in range(7)] + [(9_999, 7)]
    df = spark.createDataFrame(rows, "flow_id long, label int").withColumn("fold", F.lit("replaced"))
    want = {}
    for bound in (10, 400, 100_000):  # buckets of about so many rows
        found = sampling.stratified_fold(df, 5, rank_rows=bound)
        assert found.dtypes == [("flow_id", "bigint"), ("label", "int"), ("fold", "int")]
        folds = {r["flow_id"]: r["fold"] for r in found.collect()}
        want = want or folds
        assert folds == want and len(folds) == len(rows)
        counts = {}
        for i, label in rows:
            counts.setdefault(label, [0] * 5)[folds[i]] += 1
        assert all(max(c) - min(c) <= 1 for c in counts.values())
    assert sampling.stratified_fold(df.limit(0), 5).isEmpty()
    assert not math.isnan(want[0])


def test_few_rows_are_fitted_in_one_job_like_many(noisy, spark):
    rows = noisy.select("x", F.when(F.col("label") > 0, 1.0).otherwise(-1.0).alias("y"), (F.col("flow_id") % 3).cast("int").alias("fold"))
    rows = rows.repartition(3, "fold").persist()
    lifts = [svm.plain, svm.FourierMap(3, 0.5, 16).lift()]
    tried = [machines.Machine(k, p, h) for k in (0, 1) for p in (1e-1, 1e-3) for h in (None, 0, 2)]
    context, found = spark.sparkContext, []
    for held in (machines.HELD, 0):
        context.setJobGroup(f"held-{held}", "fit")
        found.append(machines.Machines(rows, lifts, tried, held=held).fit(1e-6))
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    assert len(tracker.getJobIdsForGroup(f"held-{machines.HELD}")) <= 12 < 24 < len(tracker.getJobIdsForGroup("held-0"))
    for a, b in zip(*found):
        assert (a.steps, a.converged) == (b.steps, b.converged) and a.loss == pytest.approx(b.loss, rel=1e-9)
        assert np.allclose(a.weights, b.weights, rtol=1e-6, atol=1e-9)
    stopped = machines.Machines(rows, lifts, tried).fit(1e-9, max_steps=3)
    assert not any(f.converged for f in stopped) and len(stopped) == len(tried)
    rows.unpersist()


def test_sums_of_many_rows_by_spark_equal_sums_on_the_driver(noisy):
    _, here = fitted(noisy, [1e-2], held=0)
    _, there = fitted(noisy.repartition(5), [1e-2], direct_tasks=1, held=0)
    for a, b in zip(here, there):
        assert np.allclose(a.weights, b.weights, atol=1e-3) and a.loss == pytest.approx(b.loss)

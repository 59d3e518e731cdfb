"""The exact RBF machine against optimality conditions and a plain dual ascent over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.operators import kernel
from weirgate.operators.features import FlowFeaturesModel
from weirgate.sources import bundles

C, GAMMA = 2.0, 0.7
EMPTY = '{"numeric": [], "categorical": [], "medians": {}, "means": {}, "stds": {}, "selected": []}'


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(((a > 0) != (b > 0)) ^ (rng.random() < .1)), [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(0, 1, (150, 2)))]
    rows += [(150 + i, rows[i][1], rows[i][2]) for i in range(10)]  # repeated rows
    return spark.createDataFrame(rows, "id long, label int, x array<double>").persist()


def brute(x, y):
    """Maximise the dual one pair after the other until no pair gains anything."""
    k, beta = kernel.kernel(x, x, GAMMA), np.zeros(len(y))
    low, high = np.minimum(0, C * y), np.maximum(0, C * y)
    gain = 1.0
    while gain > 1e-9:
        gain = 0.0
        for i in range(len(y)):
            for j in range(len(y)):
                bend = k[i, i] + k[j, j] - 2 * k[i, j]
                if i == j or bend < 1e-12:
                    continue
                slope = (y[i] - k[i] @ beta) - (y[j] - k[j] @ beta)
                step = np.clip(slope / bend, max(low[i] - beta[i], beta[j] - high[j]), min(high[i] - beta[i], beta[j] - low[j]))
                beta[i] += step
                beta[j] -= step
                gain = max(gain, slope * step - bend * step * step / 2)
    return y @ beta - beta @ k @ beta / 2, beta, k


def test_equals_the_dual_solution(noisy):
    small = noisy.filter("id < 40")
    local = small.orderBy("id").toPandas()
    x, y = np.stack(local["x"]), np.where(local["label"] > 0, 1.0, -1.0)
    best, beta, k = brute(x, y)
    machine = kernel.fit(small, C, GAMMA, tol=1e-6, group_rows=10)
    mine = kernel.kernel(machine.support, machine.support, GAMMA)
    signs = np.sign(machine.weights)
    assert signs @ machine.weights - machine.weights @ mine @ machine.weights / 2 == pytest.approx(best, abs=1e-5)
    free = np.flatnonzero((np.abs(beta) > 1e-4) & (np.abs(beta) < C - 1e-4))
    bias = np.mean(y[free] - k[free] @ beta)
    assert np.allclose(machine.decide(x), k @ beta + bias, atol=1e-3)


@pytest.mark.parametrize("group_rows", [20, 1_000])
def test_no_row_violates_whatever_the_groups(noisy, group_rows):
    machine = kernel.fit(noisy, C, GAMMA, tol=1e-4, group_rows=group_rows)
    assert abs(machine.weights.sum()) < 1e-9 and np.abs(machine.weights).max() <= C
    local = noisy.toPandas()
    x, y = np.stack(local["x"]), np.where(local["label"] > 0, 1.0, -1.0)
    margin = y * machine.decide(x)
    support = {tuple(v) for v in machine.support}
    unused = np.array([tuple(v) not in support for v in x])
    assert unused.any() and (margin[unused] > 1 - 1e-4).all()
    free = np.abs(machine.weights) < C
    assert np.allclose(machine.decide(machine.support)[free], np.sign(machine.weights)[free], atol=2e-4)
    scored = machine.transform(noisy).toPandas()
    assert (scored["prediction"] == scored["label"]).mean() >= 0.85


def test_one_class_no_rows_and_too_many(noisy):
    one = kernel.fit(noisy.filter("label = 1"), C, GAMMA, group_rows=20)
    assert one.transform(noisy).filter("prediction = 0").isEmpty()
    for rows, bound in ((noisy.limit(0), 10), (noisy, 10)):
        with pytest.raises(ValueError, match="rows to train on"):
            kernel.fit(rows, max_rows=bound)


def test_saved_machine_answers_the_same(spark, noisy, tmp_path):
    machine = kernel.fit(noisy.withColumn("label", F.when(F.col("id") % 7 > 0, F.col("label"))), C, GAMMA)
    assert machine.settings["rows"] == noisy.filter("id % 7 > 0").count()
    features = FlowFeaturesModel.from_json(EMPTY)
    bundles.save(bundles.Bundle("svm", "svm", features, machine), spark, str(tmp_path))
    loaded = bundles.load(spark, "svm", str(tmp_path)).model
    x = np.random.default_rng(0).normal(0, 1, (50, 2))
    assert np.allclose(loaded.decide(x), machine.decide(x)) and loaded.settings == machine.settings

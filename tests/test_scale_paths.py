"""The ways taken only by large inputs, forced on small ones and compared with brute force."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.operators import evaluate, sampling
from weirgate.operators.asof import asof_last
from weirgate.operators.medians import exact_medians
from weirgate.operators.neighbors import with_neighbors
from weirgate.operators.smote import smote


def test_medians_by_narrowing(spark):
    rng = np.random.default_rng(1)
    n = 4001
    skew = [float(v) for v in rng.exponential(size=n)]
    hot = [7.0 if rng.random() < 0.4 else float(v) for v in rng.normal(7, 3, n)]
    even = [float(v) if i else None for i, v in enumerate(rng.integers(0, 50, n))]
    two = [0.0] * 2000 + [1.0] * 2000 + [None]
    df = spark.createDataFrame(list(zip(skew, hot, even, two, [None] * n)),
                               "skew double, hot double, even double, two double, none double").repartition(5)
    columns = df.columns
    want = {c: statistics.median([v for v in vals if v is not None])
            for c, vals in zip(columns, (skew, hot, even, two))} | {"none": None}
    assert exact_medians(df, columns) == want
    assert exact_medians(df, columns, small_rows=40, accuracy=50) == want
    assert exact_medians(df, columns, small_rows=1, accuracy=10_000) == want


@pytest.mark.parametrize("narrowing", [{}, {"digits": 1, "rank_rows": 20}, {"digits": 2, "rank_rows": 0}])
def test_caps_take_the_smallest_hashes(spark, narrowing):
    rows = [(i, 0 if i % 10 else 1) for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "flow_id long, label int")
    key = sampling.order_key(42, F.col("flow_id"))
    hashed = {r.flow_id: (r.k, r.label) for r in df.select("flow_id", "label", key.alias("k")).collect()}
    for cls, size in ((0, 500), (1, 300)):
        members = sorted((k, i) for i, (k, c) in hashed.items() if c == cls)
        got = sampling.stratified_cap(df, 500, **narrowing).filter(F.col("label") == cls)
        assert {r.flow_id for r in got.collect()} == {i for _, i in members[:size]}
    everyone = sorted((k, i) for i, (k, _) in hashed.items())
    got = sampling.row_cap(df.repartition(7), 777, **narrowing).collect()
    assert {r.flow_id for r in got} == {i for _, i in everyone[:777]}
    assert sampling.row_cap(df, 10_000).count() == 3001


def test_split_is_stable_and_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "flow_id")
    train, test = sampling.split(df)
    other = sampling.split(df.repartition(9))[1]
    assert {r[0] for r in test.collect()} == {r[0] for r in other.collect()}
    assert train.intersect(test).isEmpty() and train.count() + test.count() == 2000
    assert 0.25 < test.count() / 2000 < 0.35


def brute(queries, rows, k, p):
    out = {}
    for qi, qx in queries:
        d = []
        for i, label, x in rows:
            diff = np.abs(np.array(qx) - np.array(x))
            d.append((float(diff.sum()) if p == 1 else float(np.sqrt((diff * diff).sum())), i, label))
        out[qi] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("p", [1, 2])
def test_neighbors_agree_with_brute_force(spark, p):
    rng = np.random.default_rng(3)
    # A third of the rows are copies of one point; the grid makes many exact ties.
    points = [[0.0, 0.0]] * 200 + [[float(a), float(b)] for a, b in rng.integers(-6, 6, (400, 2))]
    rows = [(int(i), int(i % 3 == 0), x) for i, x in zip(rng.permutation(600), points)]
    queries = [(1000 + i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.uniform(-7, 7, (60, 2)))]
    queries += [(2000 + i, [0.0, 0.0]) for i in range(40)]
    reference = spark.createDataFrame(rows, "id long, label int, x array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "id long, x array<double>").repartition(3)
    want = brute(queries, rows, 7, p)
    small = with_neighbors(asked, reference, 7, p)
    large = with_neighbors(asked, reference, 7, p, broadcast_rows=10, cell_rows=60, block_rows=25)
    for df in (small, large):
        got = {r.id: [(n.distance, n.id, n.label) for n in r.neighbors] for r in df.collect()}
        assert got == want


def test_fewer_rows_than_neighbors(spark):
    reference = spark.createDataFrame([(1, 0, [0.0]), (2, 1, [5.0])], "id long, label int, x array<double>")
    asked = spark.createDataFrame([(9, [1.0])], "id long, x array<double>")
    for limits in ({}, {"broadcast_rows": 1, "cell_rows": 1, "block_rows": 1}):
        row = with_neighbors(asked, reference, 5, **limits).first()
        assert [n.id for n in row.neighbors] == [1, 2]


def test_smote_is_the_same_both_ways(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1 if i < 60 else 0, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "flow_id long, label int, x array<double>").repartition(4)
    key = lambda r: (r.base_id, r.copy)
    small = sorted(smote(df).collect(), key=key)
    large = sorted(smote(df, broadcast_rows=5, cell_rows=10, block_rows=6).collect(), key=key)
    assert small == large and len(small) == 80
    assert len({r.id for r in small}) == 80 and max(r.id for r in small) < 0
    points = {i: np.array(x) for i, _, x in rows}
    for r in small:
        a, b, x = points[r.base_id], points[r.neighbor_id], np.array(r.x)
        assert r.base_id < 60 and r.neighbor_id < 60 and r.base_id != r.neighbor_id
        assert abs(np.linalg.norm(x - a) + np.linalg.norm(b - x) - np.linalg.norm(b - a)) < 1e-9


def test_smote_edges(spark):
    schema = "flow_id long, label int, x array<double>"
    even = spark.createDataFrame([(i, i % 2, [float(i)]) for i in range(20)], schema)
    assert smote(even).isEmpty()
    tiny = spark.createDataFrame([(i, int(i < 3), [float(i)]) for i in range(20)], schema)
    with pytest.raises(ValueError, match="3 rows"):
        smote(tiny)


@pytest.mark.parametrize("slice_rows", [10_000, 50, 7])
def test_asof_on_a_hot_key(spark, slice_rows):
    rng = np.random.default_rng(7)
    key = lambda: "hot" if rng.random() < 0.5 else str(rng.integers(5))
    facts = [(key(), int(rng.integers(0, 300)), i, int(rng.integers(100))) for i in range(200)]
    probes = [(key(), int(rng.integers(0, 300)), 500 + i) for i in range(300)] + [("none", 5, 1000)]
    got = asof_last(
        spark.createDataFrame(probes, "k string, time_us long, event_id long").repartition(3),
        spark.createDataFrame(facts, "k string, time_us long, event_id long, v int").repartition(3),
        ["k"], "v", "seen", slice_rows=slice_rows).collect()
    assert len(got) == len(probes)
    for r in got:
        past = [f for f in facts if f[0] == r.k and (f[1], f[2]) <= (r.time_us, r.event_id)]
        assert r.seen == (max(past, key=lambda f: (f[1], f[2]))[3] if past else None)


@pytest.mark.parametrize("slice_rows", [10_000, 9])
def test_auc_in_slices(spark, slice_rows):
    rng = np.random.default_rng(9)
    rows = [(int(y), float(np.round(rng.normal(y, 1.5), 1))) for y in rng.integers(0, 2, 400)]
    got = evaluate.auc(spark.createDataFrame(rows, "y int, s double"), "s", slice_rows=slice_rows).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got.auc - want) < 1e-12 and (got.positives, got.negatives) == (len(pos), len(neg))

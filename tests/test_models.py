"""Planted data with known answers, since the fixture labels are mostly noise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.functions import cleaning
from weirgate.operators import knn, naive_bayes, sampling, svm, trees
from weirgate.operators.features import FlowFeatures, f_score
from weirgate.plans import training
from weirgate.sources import bundles

ALL = {**training.LIVE, **training.NAIVE_BAYES}


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((i, y, float(rng.normal(10 * y, 1)), float(rng.normal(-10 * y, 1)), "S" if rng.random() < 0.5 else "SA"))
    return spark.createDataFrame(rows, "flow_id long, label int, packet_count double, byte_count double, flags string").cache()


@pytest.fixture(scope="module")
def xor(spark):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(400):
        a, b = i % 2, (i // 2) % 2
        rows.append((i, a ^ b, [float(4 * a - 2 + rng.normal(0, 0.4)), float(4 * b - 2 + rng.normal(0, 0.4))]))
    return spark.createDataFrame(rows, "flow_id long, label int, x array<double>").cache()


@pytest.fixture(scope="module")
def trained(spark, separable, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    models, status = training.train_all(spark, training.prepare(separable), root, ALL)
    return root, models, {r.model: r for r in status.collect()}


def test_every_model_learns(trained):
    _, models, status = trained
    assert set(status) == set(ALL) == set(models)
    for name, row in status.items():
        assert row.ok and row.accuracy >= 0.99, name


def test_saved_models_predict_the_same(spark, separable, trained):
    root, models, _ = trained
    loaded = bundles.load_all(spark, root, list(ALL))
    assert set(loaded) == set(ALL)
    a = training.predict_all(separable, models, list(ALL)).select("flow_id", *ALL).orderBy("flow_id").collect()
    b = training.predict_all(separable, loaded, list(ALL)).select("flow_id", *ALL).orderBy("flow_id").collect()
    assert a == b
    assert training.weights(loaded) == pytest.approx(training.weights(models))


def test_broken_and_missing_bundles(spark, separable, trained, tmp_path):
    root, _, _ = trained
    loaded = bundles.load_all(spark, root, ["decision_tree", "no_such_model"])
    assert set(loaded) == {"decision_tree"}
    scored = training.predict_all(separable, loaded)
    assert scored.filter("decision_tree IS NULL").isEmpty()
    assert scored.filter("knn IS NOT NULL OR svm IS NOT NULL").isEmpty()
    bundles.save(loaded["decision_tree"], spark, str(tmp_path / "m"))
    meta = spark.read.schema(bundles.META).parquet(str(tmp_path / "m" / "meta"))
    meta.withColumn("accuracy", F.lit(None).cast("double")).write.parquet(str(tmp_path / "n"))
    (tmp_path / "m" / "meta").rename(tmp_path / "old")
    (tmp_path / "n").rename(tmp_path / "m" / "meta")
    assert bundles.load(spark, "decision_tree", str(tmp_path / "m")).accuracy == 1.0


def test_load_or_train(spark, separable, tmp_path):
    reads = []

    def read():
        reads.append(1)
        return separable

    one = {"decision_tree": training.LIVE["decision_tree"]}
    for _ in range(2):
        models = training.load_or_train(spark, str(tmp_path / "models"), read, one)
        assert models["decision_tree"].accuracy >= 0.99
    assert reads == [1]


def test_training_goes_on_after_a_failure(spark, separable):
    def fail(_):
        raise RuntimeError("no luck")

    trainers = {"broken": fail, "decision_tree": training.LIVE["decision_tree"]}
    models, status = training.train_all(spark, training.prepare(separable), trainers=trainers)
    rows = {r.model: r for r in status.collect()}
    assert set(models) == {"decision_tree"} and not rows["broken"].ok and "no luck" in rows["broken"].error
    assert tuple(training.trained_count(status).first()) == (1, 2)


def test_any_mllib_model_can_join(spark, separable, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    trainers = {"logistic": lambda p: (LogisticRegression().fit(p.balanced.select("features", "label")), {})}
    training.train_all(spark, training.prepare(separable), str(tmp_path), trainers)
    loaded = bundles.load_all(spark, str(tmp_path), ["logistic"])
    scored = training.predict_all(separable, loaded, ["logistic", "knn"])
    assert scored.filter("logistic = label").count() >= 396 and scored.filter("knn IS NOT NULL").isEmpty()


def test_a_model_that_does_not_fit_is_left_out(spark, trained, separable):
    _, models, _ = trained
    broken = dict(models)
    narrow = svm.FourierMap(1, 1.0, 8)
    broken["svm"] = bundles.Bundle("svm", "svm", models["svm"].features, svm.SvmModel(models["svm"].model.linear, narrow, {}))
    with pytest.raises(ValueError):
        broken["svm"].verify()
    scored = training.predict_all(separable, broken, list(ALL))
    assert scored.filter("svm IS NOT NULL").isEmpty() and scored.filter("decision_tree = label").count() >= 396


def test_held_out_scores_use_every_held_out_row(spark, separable):
    p = training.prepare(separable, class_cap=20)
    assert p.plain.groupBy("label").count().filter("count > 20").isEmpty()
    assert p.test.count() == separable.filter(sampling.is_test()).count() > 100


def test_empty_training_data(separable):
    with pytest.raises(ValueError, match="empty"):
        training.prepare(separable.filter("label > 5"))


def test_split_after_resampling_keeps_the_leak(separable):
    p = training.prepare(separable, split_first=False)
    assert p.balanced.count() + p.test.count() == 400


def test_kernels_on_xor(xor):
    def accuracy(kernel):
        model = svm.fit(xor, kernel=kernel)
        return model.transform(xor).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]

    assert accuracy("rbf") >= 0.95
    assert accuracy("linear") <= 0.8


def test_gamma(xor):
    matrix = np.array([r.x for r in xor.collect()])
    assert svm.gamma_value(xor, "scale") == pytest.approx(1 / (2 * matrix.var()))
    assert svm.gamma_value(xor, "auto") == 0.5 and svm.gamma_value(xor, 0.25) == 0.25


def test_searches_prefer_what_fits(xor):
    grid = {"C": [1], "kernel": ["linear", "rbf"], "gamma": ["scale"]}
    assert svm.grid_search(xor, 3, grid)[0][0]["kernel"] == "rbf"
    vectors = training._vectors(xor)
    candidates = [{"maxDepth": 1, "minInstancesPerNode": 1, "impurity": "gini"},
                  {"maxDepth": 5, "minInstancesPerNode": 1, "impurity": "gini"}]
    model, scores = trees.tune_tree(vectors, 3, candidates)
    assert model.depth > 1 and dict(map(lambda s: (s[0]["maxDepth"], s[1]), scores))[5] >= 0.95
    best = knn.fit(knn.training_rows(xor), knn.LIVE_GRID, 3)
    assert best.transform(xor).filter("label = prediction").count() >= 395


def test_cut_trees_equal_trees_fitted_with_the_limit(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int((a > 0) ^ (b > 0) ^ (rng.random() < .2)), [float(a), float(b), float(c)])
            for i, (a, b, c) in enumerate(rng.normal(0, 1, (400, 3)))]
    df = training._vectors(spark.createDataFrame(rows, "flow_id long, label int, x array<double>"))
    for leaf in (1, 5):
        deep = trees.tree(minInstancesPerNode=leaf, maxDepth=30).fit(df)
        paths = trees.leaf_paths(deep)
        counts = trees._table(trees._leaf_counts(deep, df, [], "label"), len(paths), 2)
        assert len(paths) == (deep.numNodes + 1) // 2 and max(map(len, paths)) == deep.depth + 1
        for depth in (1, 2, 3, 6):
            cut = trees.CutTree(deep, trees.cut_leaves(paths, counts, depth, 2)).transform(df, "mine").select("flow_id", "mine")
            direct = trees.tree(minInstancesPerNode=leaf, maxDepth=depth).fit(df).transform(df)
            assert direct.join(cut, "flow_id").filter("mine = prediction").count() == 400
        whole = trees.cut_leaves(paths, counts, 30, 10 ** 6)
        assert len(set(whole)) == 1  # the root is not split


def test_tree_grid_size():
    assert len(trees.tree_candidates()) == 42
    assert {c["maxDepth"] for c in trees.tree_candidates()} == {10, 20, 30}
    assert len(svm.candidates()) == 12


def near(spark, items):
    df = spark.createDataFrame([(items,)], "neighbors array<struct<distance: double, id: bigint, label: int>>")
    return lambda k, w: df.select(knn.vote(F.col("neighbors"), k, w, [0, 1])).first()[0]


def test_votes_of_neighbors(spark):
    vote = near(spark, [(0.0, 1, 1), (0.5, 2, 0), (0.6, 3, 0), (0.7, 4, 1)])
    assert vote(3, "uniform") == 0
    assert vote(3, "distance") == 1      # only exact matches count
    assert vote(4, "uniform") == 0       # the lower class wins a tie
    vote = near(spark, [(0.1, 1, 1), (1.0, 2, 0), (1.0, 3, 0)])
    assert (vote(3, "uniform"), vote(3, "distance")) == (0, 1)


def test_naive_bayes_moments(spark):
    rng = np.random.default_rng(17)
    rows = [(i, i % 2, [float(v) for v in rng.normal(i % 2, 1, 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "flow_id long, label int, x array<double>")
    model = naive_bayes.fit(df, smoothing=1e-9)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    floor = 1e-9 * x.var(axis=0).max()
    score = []
    for c in (0, 1):
        m, v = x[y == c].mean(axis=0), x[y == c].var(axis=0) + floor
        score.append(math.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1))
    want = np.argmax(score, axis=0)
    got = [r.prediction for r in model.transform(df).orderBy("flow_id").collect()]
    assert got == list(want)
    assert len(naive_bayes.grid_search(df)) == 5


def test_odd_columns(spark):
    rows = [(i, i % 2, None, 5.0, float(i % 2), float(i), "b" if i % 3 else "a") for i in range(40)]
    df = spark.createDataFrame(
        rows, "flow_id long, label int, packet_count double, byte_count double, idle_timeout double, "
              "flow_duration_sec double, flags string")
    model = FlowFeatures().fit(df)
    scores = {f.name: f.score for f in model.selected}
    assert scores["packet_count"] is None and scores["byte_count"] is None   # all null, constant
    assert scores["idle_timeout"] == math.inf                                # separates perfectly
    assert model.medians["packet_count"] == 0.0 and model.stds["byte_count"] == 1.0
    assert [f.name for f in FlowFeatures(k=1).fit(df).selected] == ["idle_timeout"]
    # Unseen category: all indicators 0. Missing column: its default.
    new = spark.createDataFrame([(1, "zz")], "flow_id long, flags string")
    values = {r.feature: r.value for r in model.long(new).collect()}
    assert values["flags_a"] == 0.0 and values["flags_b"] == 0.0
    assert values["flow_duration_sec"] == pytest.approx(-model.means["flow_duration_sec"] / model.stds["flow_duration_sec"])
    again = type(model).from_json(model.to_json())
    assert again.selected == model.selected


def test_equal_scores_keep_the_later_column(spark):
    rows = [(i, i % 2, float(i % 4 == 1), float(i % 4 == 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "flow_id long, label int, packet_count double, byte_count double")
    assert [f.name for f in FlowFeatures(k=1).fit(df).selected] == ["byte_count"]


def test_f_score():
    assert f_score([(3, 1.0, 2 / 3, 0.0, 2.0), (3, 2.0, 2 / 3, 1.0, 3.0)]) == pytest.approx(1.5)
    assert f_score([(2, 1.0, 0.0, 1.0, 1.0), (2, 1.0, 0.0, 1.0, 1.0)]) is None
    assert f_score([(2, 1.0, 0.0, 1.0, 1.0), (2, 2.0, 1e-30, 2.0, 2.0)]) == float("inf")
    assert f_score([(5, 1.0, 1.0, 0.0, 2.0)]) is None


def test_constant_columns_do_not_round_into_features(spark):
    rows = [(i, i % 7 % 2, 0.1, float(i % 5 + i % 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "flow_id long, label int, same double, real double")
    model = FlowFeatures(1, numeric=["same", "real"], categorical=[]).fit(df)
    kept = model.to_json()
    assert '"real"' in kept and model.transform(df).select("x").first()[0] != [0.0]
    both = FlowFeatures(2, numeric=["same", "real"], categorical=[]).fit(df)
    assert {round(v, 9) for r in both.transform(df).select("x").collect() for v in r.x[:1]} == {0.0} or \
        {round(r.x[1], 9) for r in both.transform(df).select("x").collect()} == {0.0}


def test_knn_without_a_flow_id_survives_a_refused_broadcast(spark, monkeypatch):
    from weirgate.operators import knn, neighbors
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(i % 2 * 3 + a), float(b)]) for i, (a, b) in enumerate(rng.normal(0, .3, (80, 2)))]
    train = spark.createDataFrame(rows[:60], "id long, label int, x array<double>")
    asked = spark.createDataFrame([r[1:] for r in rows[60:]], "label int, x array<double>")
    want = sorted(map(str, knn.KnnModel(train, [0, 1], 3).transform(asked).collect()))
    monkeypatch.setattr(knn, "share_if_small", lambda *a, **k: None)
    monkeypatch.setattr(neighbors, "share_if_small", lambda *a, **k: None)
    got = knn.KnnModel(train, [0, 1], 3).transform(asked)
    assert got.columns == [*asked.columns, "prediction"] and sorted(map(str, got.collect())) == want


def test_live_rows_fit_the_models(spark, trained):
    _, models, _ = trained
    flows = spark.createDataFrame([(1, 10, 10, 0), (2, 0, 5, 5)], "flow_id long, packets long, bytes long, duration_sec long")
    scored = training.predict_all(cleaning.live_features(flows), models, list(ALL))
    assert scored.count() == 2 and {r.decision_tree for r in scored.collect()} <= {0, 1}

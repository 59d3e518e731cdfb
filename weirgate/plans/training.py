"""Offline training: prepare once, train every model, report."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.operators import kernel, knn, naive_bayes, svm, trees
from weirgate.operators.features import FlowFeatures, FlowFeaturesModel
from weirgate.operators.sampling import is_test, row_cap, stratified_cap
from weirgate.operators.smote import balance
from weirgate.schemas import MODEL_NAMES
from weirgate.sources import bundles
from weirgate.sources.bundles import Bundle
from weirgate.sources.flow_files import require_rows
from weirgate.workspace import cut_lineage

log = logging.getLogger(__name__)

#: Bounds of what models are fitted on: rows per class, and rows of a support vector machine. Scores always come
#: from all held-out rows.
CLASS_CAP = 2000
SVM_ROWS = 30_000
ROWS_PER_FILE = 1_000
STATUS = "model string, ok boolean, accuracy double, error string"


@dataclass
class Prepared:
    """Training and test rows as (id, label, x, features), shared by all models."""

    features: FlowFeaturesModel
    balanced: DataFrame
    plain: DataFrame
    test: DataFrame


def _training_columns():
    return F.col("flow_id").cast("bigint").alias("id"), F.col("label").cast("int").alias("label"), "x"


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


def prepare(df: DataFrame, class_cap: int | None = CLASS_CAP, split_first: bool = True,
            k_features: int = 50, seed: int = 42) -> Prepared:
    """Split, cap the training rows, fit features, balance.

    ``split_first`` caps, fits features and balances on the training rows only, and all
    held-out rows are scored, so that accuracies and the vote weights made of them reflect the real mix of classes. Without
    it everything happens before the split, as the behaviour to match does, and scores
    leak. The feature rows are written once and read by every trainer.
    """
    rows = require_rows(df.dropna(subset=["label"]), "training data")
    # A few thousand rows from all over the table: gather them in few files.
    files = max(1, 2 * class_cap // ROWS_PER_FILE) if class_cap else None
    if split_first:
        held_out = is_test(seed=seed)
        fitted = rows.filter(~held_out)
        fitted = cut_lineage(stratified_cap(fitted, class_cap, seed=seed) if class_cap else fitted, files)
        model = FlowFeatures(k_features).fit(fitted)
        plain = cut_lineage(model.transform(fitted).select(*_training_columns()), files)
        held = cut_lineage(model.transform(rows.filter(held_out)).select(*_training_columns()))
        balanced = cut_lineage(balance(plain, id_col="id", seed=seed), files)
    else:
        rows = cut_lineage(stratified_cap(rows, class_cap, seed=seed) if class_cap else rows, files)
        model = FlowFeatures(k_features).fit(rows)
        everything = cut_lineage(model.transform(rows).select(*_training_columns()), files)
        resampled = cut_lineage(balance(everything, id_col="id", seed=seed), files)
        chosen = is_test("id", seed=seed)
        balanced, held = resampled.filter(~chosen), resampled.filter(chosen)
        plain = everything.filter(~chosen)
    return Prepared(model, _vectors(balanced), _vectors(plain), _vectors(held))


def _train_knn(p: Prepared, grid: dict, folds: int):
    rows = p.balanced.select("id", "label", "x")
    model = knn.fit(rows, grid, folds)
    return model, {}


def _train_forest(p: Prepared, **options):
    return trees.forest(**options).fit(p.balanced.select("features", "label")), {}


def _train_tree(p: Prepared, **options):
    return trees.tree(**options).fit(p.balanced.select("features", "label")), {}


def _tune_tree(p: Prepared, folds: int, candidates: list[dict] | None = None):
    model, scores = trees.tune_tree(p.balanced, folds, candidates, id_col="id", stratified=True)
    return model, dict(max(scores, key=lambda s: s[1])[0])


def _train_svm(p: Prepared, max_rows: int = SVM_ROWS, **options):
    """A machine on at most ``max_rows`` of the training rows."""
    rows = row_cap(p.balanced.select("id", "label", "x"), max_rows, "id")
    return svm.fit(rows, **{**svm.LIVE, **options}), {}


def train_kernel(p: Prepared, max_rows: int = SVM_ROWS, **options):
    """An exact RBF machine on at most ``max_rows`` of the training rows."""
    rows = row_cap(p.balanced.select("id", "label", "x"), max_rows, "id")
    return kernel.fit(rows, max_rows=max_rows, **options), {}


def _tune_svm(p: Prepared, folds: int, grid: dict | None = None):
    rows = p.balanced.select("id", "label", "x")
    best = svm.grid_search(rows, folds, grid, id_col="id")[0][0]
    return svm.fit(rows, best["C"], best["kernel"], best["gamma"]), {}


def _train_naive_bayes(p: Prepared, folds: int = 5):
    """Trained on the rows as they are: this model is not balanced."""
    smoothing = naive_bayes.grid_search(p.plain, folds, id_col="id")[0][0]
    return naive_bayes.fit(p.plain, smoothing=smoothing), {}


Trainer = Callable[[Prepared], tuple[object, dict]]

# Live settings: small fixed models, short KNN grid.
LIVE: dict[str, Trainer] = {
    "knn": lambda p: _train_knn(p, knn.LIVE_GRID, 3),
    "random_forest": _train_forest,
    "decision_tree": _train_tree,
    "svm": _train_svm,
}

# Offline settings: full grids, five folds.
OFFLINE: dict[str, Trainer] = {
    "knn": lambda p: _train_knn(p, knn.OFFLINE_GRID, 5),
    "random_forest": _train_forest,
    "decision_tree": lambda p: _tune_tree(p, 5),
    "svm": lambda p: _tune_svm(p, 5),
}

NAIVE_BAYES: dict[str, Trainer] = {"naive_bayes": _train_naive_bayes}


def train_all(spark: SparkSession, prepared: Prepared, root: str | None = None,
              trainers: dict[str, Trainer] | None = None) -> tuple[dict[str, Bundle], DataFrame]:
    """Train and score every model; a failure is recorded and the rest goes on.

    Returns the bundles and a status row per model. With ``root`` each bundle is
    also saved to ``root/<model>``.
    """
    def attempt(name: str, trainer: Trainer):
        try:
            model, settings = trainer(prepared)
            bundle = Bundle(name, name, prepared.features, model, settings=settings)
            scored = bundle.predict(prepared.test, "prediction")
            hit = (F.col("label") == F.col("prediction")).cast("double")
            bundle.accuracy = scored.agg(F.avg(hit)).first()[0]
            if bundle.accuracy is None:
                raise ValueError("no test rows to score")
            if root:
                bundles.save(bundle, spark, f"{root}/{name}")
            return bundle, (name, True, float(bundle.accuracy), None)
        except Exception as error:  # one model must not stop the others
            log.error("training %s failed: %s", name, error)
            return None, (name, False, None, str(error)[:500])

    todo = LIVE if trainers is None else trainers
    # Each trainer is a chain of short jobs; run side by side they share the cluster.
    with ThreadPoolExecutor(max_workers=max(1, len(todo))) as pool:
        done = list(pool.map(attempt, todo.keys(), todo.values()))
    trained = {bundle.name: bundle for bundle, _ in done if bundle}
    status = [row for _, row in done]
    return trained, spark.createDataFrame(status, STATUS)


def trained_count(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if("ok").alias("trained"), F.count("*").alias("models"))


def load_or_train(spark: SparkSession, root: str, read_training: Callable[[], DataFrame],
                  trainers: dict[str, Trainer] | None = None, **options) -> dict[str, Bundle]:
    """Load if every bundle is there, else train all and load what was saved."""
    trainers = LIVE if trainers is None else trainers
    if not all(bundles.exists(spark, f"{root}/{name}") for name in trainers):
        train_all(spark, prepare(read_training(), **options), root, trainers)
    return bundles.load_all(spark, root, list(trainers))


def predict_all(df: DataFrame, models: dict[str, Bundle], names: list[str] | None = None) -> DataFrame:
    """Add one nullable 0/1 column per model; a missing or failing model leaves nulls.

    Models fitted on the same features share one feature computation.
    """
    names = MODEL_NAMES if names is None else names
    groups: dict[str, list[Bundle]] = {}
    for name in names:
        if name in models:
            groups.setdefault(models[name].features.to_json(), []).append(models[name])
    out = df
    for members in groups.values():
        featured = members[0].features.transform(out)
        for bundle in members:
            try:
                featured = bundle.verify().predict(featured, bundle.name)
            except Exception as error:  # the vote goes on without this model
                log.error("%s cannot score: %s", bundle.name, error)
        out = featured.drop("x", "features")
    return out.withColumns({n: F.lit(None).cast("int") for n in names if n not in out.columns})


def weights(models: dict[str, Bundle]) -> dict[str, float]:
    return {name: bundle.accuracy for name, bundle in models.items()}

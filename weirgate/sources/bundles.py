"""Model bundles: one directory per model with its features, settings and accuracy."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVCModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.operators.features import FlowFeaturesModel
from weirgate.operators.kernel import KernelMachine
from weirgate.operators.knn import KnnModel
from weirgate.operators.naive_bayes import ClassMoments, GaussianNb
from weirgate.operators.svm import FourierMap, SvmModel
from weirgate.operators.trees import CutTree

log = logging.getLogger(__name__)

SUPPORT = "x array<double>, weight double"
META = "kind string, accuracy double, features string, settings string"


@dataclass
class Bundle:
    """A fitted model with the feature model it was trained on.

    ``model`` is one of this package's classifiers or any MLlib classification
    model; ``kind`` names the former.
    """

    name: str
    kind: str
    features: FlowFeaturesModel
    model: object
    accuracy: float = 1.0
    settings: dict = field(default_factory=dict)

    def verify(self) -> "Bundle":
        """Raise if the model cannot score what the feature model makes: its width, labels or settings do not fit."""
        width, model = len(self.features.selected), self.model
        widths = {"feature model": width}
        if isinstance(model, KnnModel):
            first = model.train.select("x").first()
            widths["training rows"] = len(first["x"]) if first else 0
            if model.k < 1 or model.p not in (1, 2) or model.weights not in ("uniform", "distance") or not model.labels:
                raise ValueError(f"{self.name}: unusable settings")
        elif isinstance(model, GaussianNb):
            widths |= {f"class {c}": len(m.means) for c, m in model.classes.items()}
        elif isinstance(model, KernelMachine):
            widths["support vectors"] = model.width
        elif isinstance(model, SvmModel) and model.fourier:
            widths["map"] = model.fourier.width
            if model.fourier.dimension != model.linear.numFeatures:
                raise ValueError(f"{self.name}: the machine does not fit its map")
        else:
            inner = model.linear if isinstance(model, SvmModel) else model.tree if isinstance(model, CutTree) else model
            widths["model"] = getattr(inner, "numFeatures", width)
        if set(widths.values()) != {width}:
            raise ValueError(f"{self.name}: widths differ: {widths}")
        return self

    def predict(self, featured: DataFrame, output: str) -> DataFrame:
        """Add the predicted class to rows that already carry ``x`` and ``features``."""
        if isinstance(self.model, Transformer):
            model = (self.model.setFeaturesCol("features").setPredictionCol("_p")
                     .setRawPredictionCol("_raw").setProbabilityCol("_prob"))
            scored = model.transform(featured)
            return scored.withColumn(output, F.col("_p").cast("int")).drop("_p", "_raw", "_prob")
        return self.model.transform(featured, output=output)


def save(bundle: Bundle, spark: SparkSession, path: str) -> None:
    settings = dict(bundle.settings)
    model = bundle.model
    if bundle.kind == "knn":
        model.train.write.mode("overwrite").parquet(f"{path}/train")
        settings |= {"labels": model.labels, "k": model.k, "weights": model.weights, "p": model.p}
    elif bundle.kind == "naive_bayes":
        settings |= {"smoothing": model.smoothing, "classes": {str(c): asdict(m) for c, m in model.classes.items()}}
    elif isinstance(model, KernelMachine):
        support = [(v.tolist(), float(w)) for v, w in zip(model.support, model.weights)]
        spark.createDataFrame(support, SUPPORT).coalesce(1).write.mode("overwrite").parquet(f"{path}/support")
        settings |= {"machine": {"bias": model.bias, "gamma": model.gamma, "settings": model.settings, "rounds": model.rounds}}
    elif bundle.kind == "svm":
        model.linear.write().overwrite().save(f"{path}/model")
        settings |= {"svm": model.settings, "fourier": asdict(model.fourier) if model.fourier else None}
    elif isinstance(model, CutTree):
        PipelineModel([model.tree]).write().overwrite().save(f"{path}/model")
        settings |= {"leaves": model.leaves}
    else:  # any MLlib classification model
        PipelineModel([model]).write().overwrite().save(f"{path}/model")
    meta = [(bundle.kind, float(bundle.accuracy), bundle.features.to_json(), json.dumps(settings))]
    spark.createDataFrame(meta, META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, name: str, path: str) -> Bundle:
    meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    settings = json.loads(meta["settings"] or "{}")
    kind = meta["kind"]
    if kind == "knn":
        train = spark.read.schema("id bigint, label int, x array<double>").parquet(f"{path}/train")
        model = KnnModel(train, settings["labels"], settings["k"], settings["weights"], settings["p"])
    elif kind == "naive_bayes":
        classes = {int(c): ClassMoments(**m) for c, m in settings["classes"].items()}
        model = GaussianNb(classes, settings["smoothing"])
    elif "machine" in settings:
        support = spark.read.schema(SUPPORT).parquet(f"{path}/support").collect()  # as many as the fit allowed
        model = KernelMachine(np.array([r["x"] for r in support]), np.array([r["weight"] for r in support]), **settings["machine"])
    elif kind == "svm":
        fourier = FourierMap(**settings["fourier"]) if settings["fourier"] else None
        model = SvmModel(LinearSVCModel.load(f"{path}/model"), fourier, settings["svm"])
    else:
        model = PipelineModel.load(f"{path}/model").stages[0]
        if "leaves" in settings:
            model = CutTree(model, settings["leaves"])
    accuracy = 1.0 if meta["accuracy"] is None else meta["accuracy"]
    return Bundle(name, kind, FlowFeaturesModel.from_json(meta["features"]), model, accuracy, settings)


def load_all(spark: SparkSession, root: str, names: list[str]) -> dict[str, Bundle]:
    """Every bundle that loads; a broken one is reported and skipped."""
    out = {}
    for name in names:
        try:
            out[name] = load(spark, name, f"{root}/{name}").verify()
        except Exception as error:  # a bad bundle must not stop the others
            log.error("cannot load %s: %s", name, error)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a bundle was written: its metadata comes last."""
    try:
        return not spark.read.schema(META).parquet(f"{path}/meta").isEmpty()
    except AnalysisException:
        return False

"""Classification scores as aggregations."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1_000_000
MAX_SLICES = 50_000


def accuracy(df: DataFrame, models: list[str], y: str = "y") -> DataFrame:
    """(model, accuracy) over the rows each model scored."""
    one = df.agg(*[F.avg((F.col(y) == F.col(m)).cast("double")).alias(m) for m in models])
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("accuracy")) for m in models])
    return one.select(F.inline(cells)).filter("accuracy IS NOT NULL")


def confusion(df: DataFrame, prediction: str, y: str = "y", labels: tuple = (0, 1)) -> DataFrame:
    """One row per true class, one count per predicted class."""
    return df.filter(F.col(prediction).isNotNull()).groupBy(F.col(y).alias("y")).agg(
        *[F.count_if(F.col(prediction) == c).alias(f"predicted_{c}") for c in labels])


def class_report(df: DataFrame, prediction: str, y: str = "y", labels: tuple = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages.

    One aggregation to a single row of counts; the rest is arithmetic on it. An
    undefined ratio is 0.
    """
    t, p = F.col(y), F.col(prediction)
    measures = []
    for c in labels:
        measures += [
            F.count_if((t == c) & (p == c)).alias(f"tp{c}"),
            F.count_if(p == c).alias(f"pp{c}"),
            F.count_if(t == c).alias(f"s{c}"),
        ]
    counts = df.filter(p.isNotNull() & t.isNotNull()).agg(*measures)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    per_class, rows = [], []
    for c in labels:
        tp, support = F.col(f"tp{c}").cast("double"), F.col(f"s{c}")
        precision, recall = ratio(tp, F.col(f"pp{c}")), ratio(tp, support)
        per_class.append((precision, recall, ratio(2.0 * precision * recall, precision + recall), support))
        rows.append(_report_row(str(c), *per_class[-1]))
    total = sum((p[3] for p in per_class), F.lit(0))

    def average(name: str, weights: list) -> Column:
        mass = sum(weights, F.lit(0.0))
        means = [ratio(sum((p[i] * w for p, w in zip(per_class, weights)), F.lit(0.0)), mass) for i in range(3)]
        return _report_row(name, *means, total)

    rows.append(average("macro avg", [F.lit(1.0)] * len(per_class)))
    rows.append(average("weighted avg", [p[3].cast("double") for p in per_class]))
    return counts.select(F.inline(F.array(*rows)))


def _report_row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
    return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                    f1.alias("f1"), support.cast("bigint").alias("support"))


def slice_edges(df: DataFrame, column: str, rows: int) -> list[float]:
    """Boundaries that cut ``column`` into slices of about ``rows`` rows; none if one slice will do.

    They are approximate percentiles (at most ``MAX_SLICES`` numbers on the
    driver): they only balance the work and never change a result.
    """
    n = df.filter(F.col(column).isNotNull()).count()
    wanted = min(MAX_SLICES, -(-n // rows))
    if wanted <= 1:
        return []
    grid = [i / wanted for i in range(1, wanted)]
    found = df.agg(F.percentile_approx(column, grid, max(10_000, 4 * wanted))).first()[0]
    return sorted({float(e) for e in found})


def add_slice(df: DataFrame, column: str, edges: list[float], output: str = "slice") -> DataFrame:
    """Add a slice number that grows with ``column``."""
    if not edges:
        return df.withColumn(output, F.lit(0))
    binned = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_sliced", outputCol="_slice",
                        handleInvalid="keep")
    return (
        binned.transform(df.withColumn("_sliced", F.col(column).cast("double")))
        .withColumn(output, F.col("_slice").cast("int")).drop("_sliced", "_slice")
    )


def auc(df: DataFrame, score: str, y: str = "y", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Area under the ROC curve by rank sum, ties counted half.

    Equal scores collapse before the shuffle. The running count of negatives is
    taken inside equal-depth score slices and shifted by the slices below, so no
    task ranks the whole table.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).select(
        F.col(score).cast("double").alias("score"), F.col(y).alias("y"))
    points = (
        rows.groupBy("score")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    )
    sliced = add_slice(points, "score", slice_edges(rows, "score", slice_rows))
    inside = Window.partitionBy("slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("lower", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    per_slice = ranked.groupBy("slice").agg(
        F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2.0)).alias("area"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # At most MAX_SLICES rows reach this window.
    before = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_slice.withColumn("shift", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return shifted.agg(
        F.try_divide(F.sum(F.col("area") + F.col("pos") * F.col("shift")), pairs).alias("auc"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def score_table(df: DataFrame, models: list[str], y: str = "y") -> DataFrame:
    """Accuracy, attack-class precision, recall, F1 and AUC per model, in one pass.

    For 0/1 predictions the AUC is (recall + specificity) / 2.
    """
    measures = []
    for m in models:
        p, t = F.col(m), F.col(y)
        measures += [
            F.count_if((p == 1) & (t == 1)).alias(f"{m}|tp"), F.count_if((p == 1) & (t == 0)).alias(f"{m}|fp"),
            F.count_if((p == 0) & (t == 1)).alias(f"{m}|fn"), F.count_if((p == 0) & (t == 0)).alias(f"{m}|tn")]
    one = df.agg(*measures)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    rows = []
    for m in models:
        tp, fp, fn, tn = (F.col(f"{m}|{k}").cast("double") for k in ("tp", "fp", "fn", "tn"))
        precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
        rows.append(F.struct(
            F.lit(m).alias("algorithm"), (tp + fp + fn + tn).alias("scored"),
            ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"),
            recall.alias("recall"), ratio(2.0 * precision * recall, precision + recall).alias("f1"),
            ((recall + ratio(tn, tn + fp)) / 2.0).alias("auc")))
    return one.select(F.inline(F.array(*rows))).filter("scored > 0").drop("scored")


def round_all(df: DataFrame, places: int = 4) -> DataFrame:
    """Every floating column rounded."""
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t in ("double", "float")})


def score_long(table: DataFrame, key: str = "algorithm") -> DataFrame:
    """(algorithm, metric, score): one row per bar of the comparison chart."""
    metrics = [c for c in table.columns if c != key]
    return table.unpivot(key, metrics, "metric", "score")

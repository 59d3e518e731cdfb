"""Feature engineering: impute, standardise, one-hot, select, as parameter tables.

``FlowFeatures.fit`` runs a fixed number of aggregations whatever the number of
columns; the fitted model is a set of column expressions without any action, so
it also runs on streams.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.functions.cleaning import UNKNOWN, category_text, finite, present
from weirgate.operators.medians import exact_medians
from weirgate.schemas import CATEGORICAL, LABEL, NUMERIC

K_FEATURES = 50
# Scores equal to this many digits count as ties; complementary indicator
# columns have the same F mathematically but not bit for bit.
SCORE_DIGITS = 9


@dataclass(frozen=True)
class Feature:
    name: str
    column: str
    category: str | None
    score: float | None


def is_constant(groups: list[tuple]) -> bool:
    return min(g[3] for g in groups) == max(g[4] for g in groups)


def f_score(groups: list[tuple[float, float, float, float, float]]) -> float | None:
    """ANOVA F from (count, mean, population variance, least, greatest) per class.

    ``None`` for a constant feature, +inf for one that separates perfectly. Both are seen
    from the extremes, since sums of equal numbers round.
    """
    if is_constant(groups):
        return None
    n = sum(g[0] for g in groups)
    mean = sum(g[0] * g[1] for g in groups) / n
    between = sum(g[0] * (g[1] - mean) ** 2 for g in groups)
    within = sum(g[0] * g[2] for g in groups)
    if len(groups) < 2 or n <= len(groups):
        return None
    if all(g[3] == g[4] for g in groups):
        return math.inf
    return (between / (len(groups) - 1)) / (within / (n - len(groups)))


def numeric_moments(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """count, mean, population variance and extremes per class, one row per class."""
    measures = [F.count(F.lit(1)).cast("double").alias("n")]
    for c in columns:
        measures += [F.avg(c).alias(f"{c}|mean"), F.var_pop(c).alias(f"{c}|var"),
                     F.min(c).alias(f"{c}|low"), F.max(c).alias(f"{c}|high")]
    return df.groupBy(label).agg(*measures)


def category_counts(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """(column, position, category, label, n): partial counts shrink the data before the shuffle."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(c).alias("category"))
        for i, c in enumerate(columns)
    ])
    return (
        df.select(F.col(label).alias("label"), F.inline(cells))
        .groupBy("column", "position", "category", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct categories per column."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), category_text(F.col(c), df.schema[c].dataType).alias("category"))
        for c in columns
    ])
    return df.select(F.inline(cells)).distinct()


def category_scores(counts: DataFrame, class_sizes: dict) -> DataFrame:
    """F of every indicator column from its counts alone: mean = n/N, variance = m(1-m).

    No indicator column is ever materialised, so the number of categories does
    not matter. A class in which a category never occurs contributes mean 0.
    """
    size = F.create_map(*[F.lit(x) for k, v in class_sizes.items() for x in (k, float(v))])
    total = float(sum(class_sizes.values()))
    classes = len(class_sizes)
    n = F.col("n").cast("double")
    m = n / size[F.col("label")]
    sums = counts.groupBy("column", "position", "category").agg(
        F.sum(n).alias("hits"),
        F.sum(n * m).alias("squares"),
        F.sum(n * (F.lit(1.0) - m)).alias("within"),
    )
    between = F.col("squares") - F.col("hits") * F.col("hits") / total
    within = F.col("within")
    constant = F.col("hits") == total
    # `within` is 0 exactly when every class holds only one value, since n and
    # the class sizes are whole numbers.
    score = (
        F.when(constant | F.lit(classes < 2 or total <= classes), F.lit(None))
        .when(within == 0, F.lit(float("inf")))
        .otherwise((between / max(classes - 1, 1)) / F.nullif(within / (total - classes), F.lit(0.0)))
    )
    return sums.select("column", "position", "category", score.alias("score"))


class FlowFeatures(Estimator):
    """Drop unlabelled rows, clean, impute, scale, encode, keep the K best by F."""

    def __init__(self, k: int = K_FEATURES, label: str = LABEL,
                 numeric: list[str] | None = None, categorical: list[str] | None = None):
        super().__init__()
        self.k, self.label = k, label
        self.numeric = NUMERIC if numeric is None else numeric
        self.categorical = CATEGORICAL if categorical is None else categorical

    def _fit(self, dataset: DataFrame) -> "FlowFeaturesModel":
        df = dataset.dropna(subset=[self.label])
        numeric, categorical = present(self.numeric, df), present(self.categorical, df)
        base = df.select(
            F.col(self.label),
            *[finite(F.col(c)).alias(c) for c in numeric],
            *[category_text(F.col(c), df.schema[c].dataType).alias(c) for c in categorical],
        )
        medians = {c: 0.0 if m is None else float(m) for c, m in exact_medians(base, numeric).items()}
        imputed = base.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in numeric})
        moments = [r.asDict() for r in numeric_moments(imputed, numeric, self.label).collect()]
        if not moments:
            raise ValueError("no labelled rows to fit on")
        class_sizes = {r[self.label]: r["n"] for r in moments}
        total = sum(class_sizes.values())

        means, stds, scored = {}, {}, []
        for i, c in enumerate(numeric):
            groups = [tuple(r[f"{c}|{m}"] for m in ("mean", "var", "low", "high")) for r in moments]
            groups = [(r["n"], *g) for r, g in zip(moments, groups)]
            mean = sum(g[0] * g[1] for g in groups) / total
            var = sum(g[0] * (g[2] + (g[1] - mean) ** 2) for g in groups) / total
            means[c], stds[c] = (groups[0][3], 1.0) if is_constant(groups) else (mean, math.sqrt(var) or 1.0)
            scored.append(((0, i, ""), Feature(c, c, None, f_score(groups))))

        n_features = len(numeric)
        if categorical:
            counts = category_counts(base, categorical, self.label)
            ranked = (
                category_scores(counts, class_sizes)
                .orderBy(F.round("score", SCORE_DIGITS).desc_nulls_last(),
                         F.desc("position"), F.desc("category"))
                .limit(self.k)
                .collect()
            )
            for r in ranked:
                name = f"{r['column']}_{r['category']}"
                scored.append(((1, r["position"], r["category"]),
                               Feature(name, r["column"], r["category"], r["score"])))

        # A null score ranks last. Among equal scores the later column wins, as in
        # the public selector, which takes the tail of a stable ascending sort.
        def rank(item):
            score = item[1].score
            return (-math.inf if score is None else round(score, SCORE_DIGITS), item[0])

        best = sorted(scored, key=rank, reverse=True)[: self.k]
        selected = [f for _, f in sorted(best, key=lambda item: item[0])]
        return FlowFeaturesModel(numeric, categorical, medians, means, stds, selected)


class FlowFeaturesModel(Model):
    def __init__(self, numeric, categorical, medians, means, stds, selected):
        super().__init__()
        self.numeric, self.categorical = numeric, categorical
        self.medians, self.means, self.stds = medians, means, stds
        self.selected: list[Feature] = selected

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.selected]

    def expressions(self, df: DataFrame) -> list[Column]:
        """One double column per selected feature; absent inputs take their defaults."""
        out = []
        for f in self.selected:
            if f.category is None:
                raw = finite(F.col(f.column)) if f.column in df.columns else F.lit(0.0)
                filled = F.coalesce(raw, F.lit(self.medians[f.column]))
                x = (filled - self.means[f.column]) / self.stds[f.column]
            else:
                if f.column in df.columns:
                    text = category_text(F.col(f.column), df.schema[f.column].dataType)
                else:
                    text = F.lit(UNKNOWN)
                x = (text == f.category).cast("double")
            out.append(x)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Add ``x`` (array of doubles) and ``features`` (the same as an ML vector)."""
        return (
            dataset.withColumn("x", F.array(*self.expressions(dataset)))
            .withColumn("features", array_to_vector("x"))
        )

    def long(self, df: DataFrame, id_col: str = "flow_id") -> DataFrame:
        """(id, feature, value) rows."""
        cells = [
            F.struct(F.lit(n).alias("feature"), x.alias("value"))
            for n, x in zip(self.names, self.expressions(df))
        ]
        return df.select(id_col, F.inline(F.array(*cells)))

    def to_json(self) -> str:
        return json.dumps({
            "numeric": self.numeric, "categorical": self.categorical, "medians": self.medians,
            "means": self.means, "stds": self.stds, "selected": [asdict(f) for f in self.selected],
        })

    @classmethod
    def from_json(cls, text: str) -> "FlowFeaturesModel":
        d = json.loads(text)
        d["selected"] = [Feature(**f) for f in d["selected"]]
        return cls(**d)

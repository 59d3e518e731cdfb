"""Weighted vote over model columns, and the counts reported with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5


def _masses(votes: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """(Σ vote·weight, Σ weight of the models that voted); an unknown weight counts 1."""
    total, mass = F.lit(0.0), F.lit(0.0)
    for m, v in votes.items():
        weight = float(weights.get(m, 1.0))
        total = total + F.coalesce(v * F.lit(weight), F.lit(0.0))
        mass = mass + F.when(v.isNotNull(), weight).otherwise(0.0)
    return total, mass


def vote_share(votes: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted share of attack votes in [0, 1]: a score for ranking."""
    return F.try_divide(*_masses(votes, weights))


def weighted_vote(votes: dict[str, Column], weights: dict[str, float], normalize: bool = False) -> Column:
    """1 where Σ vote·weight exceeds 0.5, null where no model voted.

    The sum is not normalised by default, so one model with a weight above 0.5 is
    enough. ``normalize`` divides by the weights of the models that voted. Row
    expression: no shuffle.
    """
    score = vote_share(votes, weights) if normalize else _masses(votes, weights)[0]
    return F.when(F.coalesce(*votes.values()).isNotNull(), (score > THRESHOLD).cast("int"))


def model_counts(df: DataFrame, models: list[str]) -> DataFrame:
    """Flagged rows and rows scored, per model that scored any."""
    measures = []
    for m in models:
        measures += [F.sum(m).cast("bigint").alias(f"{m}|flagged"), F.count(m).alias(f"{m}|total")]
    one = df.agg(*measures)
    cells = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{m}|flagged").alias("flagged"), F.col(f"{m}|total").alias("total"))
        for m in models
    ])
    return one.select(F.inline(cells)).filter("total > 0")


def verdict_summary(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Legitimate and attack rows and the attack percentage; no row when nothing was judged."""
    return (
        df.agg(F.count_if(F.col(verdict) == 0).alias("legitimate"), F.count_if(F.col(verdict) == 1).alias("attack"))
        .filter(F.col("legitimate") + F.col("attack") > 0)
        .withColumn("attack_pct", F.round(
            F.col("attack") * 100.0 / (F.col("legitimate") + F.col("attack")).cast("double"), 4))
    )

"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm.select import KEY_BITS, hash48, take_in_order
from weirgate.workspace import broadcast_if_small, cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Targets per source from ``source`` and ``source_size``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share``
    times all sizes; a source stops at ``most`` times its own size and the excess is
    shared again by weight until none is above. Filling sources in the order
    of size per weight gives that result at once: a source is full exactly when its
    cap is under what those not yet full would each get per weight.
    The table holds one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_turn", turn).withColumn("_weight", weight)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("_weight"), "_turn") \
        .rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.lit(most) * F.col("_words")
    full = ranked.withColumn("_words", F.coalesce(F.sum("source_size").over(before), F.lit(0))) \
        .withColumn("_used", F.coalesce(F.sum("_weight").over(before), F.lit(0.0))) \
        .withColumn("_level", left / (F.sum("_weight").over(every) - F.col("_used"))) \
        .withColumn("_full", F.col("_level") * F.col("_weight") >= F.lit(most) * F.col("source_size"))
    first_open = F.min(F.when(~F.col("_full"), F.struct("_words", "_turn", "_level"))).over(every)
    return full.withColumn("_open", first_open).select(
        "source", "source_size", F.col("_turn").alias("source_rank"),
        F.when(F.col("_full") | F.col("_open").isNull(), F.lit(most) * F.col("source_size"))
        .otherwise(F.col("_open._level") * F.col("_weight")).alias("target"))


def pareto_order(unit, inclusion):
    """Odds of a random number over odds of inclusion, squeezed to [0, 1): Pareto order sampling takes the least."""
    odds = (unit / (1 - unit)) / (inclusion / (1 - inclusion))
    return odds / (1 + odds)


def mix(
    docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, key: str = "doc_id",
    text: str = "text", source: str = "source", seed: str = "mix", propensity: str | None = None,
    carry: bool = False,
) -> DataFrame:
    """What a weighted mix takes of each row.

    A row's expected copies are its source's target over the source's size. The
    whole part is certain; the remaining fraction is the inclusion probability of
    one more copy, which Pareto order sampling decides: rows are ranked by the
    odds of a hash of the key over the odds of inclusion, and taken in that order until the
    source's remaining words are filled to the nearest row. ``propensity``, a
    column of numbers above 0, multiplies the odds, so that some rows are
    likelier than others at the same total. With ``carry`` the result has each row whole in a struct ``row``, so that
    no join on a key has to find it again; ``docs`` is then read twice.

    Returns ``key``, size (words; null text: 0), source_size, target, copies, taken. The
    order is a hash of key and size: reruns agree, and only rows equal in both
    tie, which are alike in the result. A null source is a source, a null key the
    empty one. Sources without words get target 0. An empty table gives no
    rows; other columns are ignored.
    """
    odds = F.coalesce(F.col(propensity).cast("double"), F.lit(1.0)) if propensity else F.lit(1.0)
    narrow = [F.col(key).alias("_key"), F.col(source).alias("source"), odds.alias("_odds"),
              F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")]
    rows = cut_lineage(docs.select(*narrow))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    same = F.col("source").eqNullSafe(F.col("_source"))
    small = broadcast_if_small(targets.withColumnRenamed("source", "_source"))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    unit = (hash48(F.col("_key"), F.col("size"), seed=seed) + F.lit(0.5)) / F.lit(float(1 << KEY_BITS))
    inclusion = F.col("_factor") - F.col("_whole")
    every = docs.select(*narrow, F.struct("*").alias("row")) if carry else rows
    placed = cut_lineage(
        every.join(small, same).drop("_source", "source").withColumn("_factor", factor)
        .withColumn("_whole", F.floor("_factor").cast("double"))
        .withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_rank", F.when(inclusion > 0, pareto_order(unit, inclusion) * F.lit(1.0)).otherwise(unit))
        .withColumn("_rank", F.when(F.col("_odds") == 1, F.col("_rank")).otherwise(
            F.col("_rank") / (F.col("_rank") + (1 - F.col("_rank")) * F.col("_odds"))))
        .withColumn("_order", F.least(F.floor(F.col("_rank") * F.lit(float(1 << KEY_BITS))),
                                      F.lit((1 << KEY_BITS) - 1)).cast("long")))
    chosen = take_in_order(placed, "source_rank", "_order", "size", "_need", ["_key", "size"])
    copies = (F.col("_whole") + F.col("chosen").cast("int")).cast("long")
    return chosen.select(F.col("_key").alias(key), "size", "source_size", "target", copies.alias("copies"),
                         (F.col("size") * copies).alias("taken"), *["row"] * carry)

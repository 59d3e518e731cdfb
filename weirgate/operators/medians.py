"""Exact medians of many columns without holding a column in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 200_000
ACCURACY = 10_000
MAX_ROUNDS = 8


@dataclass
class _Bracket:
    """Value range known to hold the ranks ``first`` and ``last`` of a column."""

    first: int
    last: int
    inside: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    stalled: bool = False


def exact_medians(
    df: DataFrame, columns: list[str], small_rows: int = SMALL_ROWS, accuracy: int = ACCURACY
) -> dict[str, float | None]:
    """Median per column, ignoring nulls; ``None`` where a column has no value.

    Up to ``small_rows`` rows the built-in exact median is used. It keeps every
    distinct value in one aggregation buffer, so larger columns are narrowed
    first: each round takes approximate percentiles around the middle ranks,
    counts exactly what lies below and inside the new range, and keeps the range
    only if the ranks are proven to be inside. The last range is read exactly.
    All columns share every pass.
    """
    if not columns:
        return {}
    if df.limit(small_rows + 1).count() <= small_rows:
        return df.agg(*[F.median(c).alias(c) for c in columns]).first().asDict()
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()

    state = {
        c: _Bracket((counts[c] - 1) // 2, counts[c] // 2, counts[c]) for c in columns if counts[c]
    }
    for _ in range(MAX_ROUNDS):
        open_ = [
            c for c, b in state.items()
            if b.inside > small_rows and not b.stalled and (b.lo is None or b.lo < b.hi)
        ]
        if not open_:
            break
        _narrow(df, {c: state[c] for c in open_}, accuracy)

    out: dict[str, float | None] = {c: None for c in columns}
    out |= _read(df, state)
    return out


def _in_range(c: str, b: _Bracket):
    return F.lit(True) if b.lo is None else F.col(c).between(b.lo, b.hi)


def _narrow(df: DataFrame, brackets: dict[str, _Bracket], accuracy: int) -> None:
    slack = 2.0 / accuracy
    approx = df.agg(*[
        F.percentile_approx(
            F.when(_in_range(c, b), F.col(c)),
            [max(0.0, (b.first - b.below) / b.inside - slack),
             min(1.0, (b.last - b.below + 1) / b.inside + slack)],
            accuracy,
        ).alias(c)
        for c, b in brackets.items()
    ]).first()
    measures = []
    for c in brackets:
        lo, hi = approx[c]
        measures += [
            F.count_if(F.col(c) < lo).alias(f"{c}|below"),
            F.count_if(F.col(c).between(lo, hi)).alias(f"{c}|inside"),
        ]
    found = df.agg(*measures).first()
    for c, b in brackets.items():
        below, inside = found[f"{c}|below"], found[f"{c}|inside"]
        proven = below <= b.first and b.last < below + inside
        if proven and inside < b.inside:
            b.stalled = inside > b.inside // 2
            b.lo, b.hi = approx[c]
            b.below, b.inside = below, inside
        else:
            b.stalled = True


def _read(df: DataFrame, state: dict[str, _Bracket]) -> dict[str, float]:
    """Values at the two middle ranks, from counts of the distinct values left in each range."""
    done = {c: b.lo for c, b in state.items() if b.lo is not None and b.lo == b.hi}
    rest = {c: b for c, b in state.items() if c not in done}
    if not rest:
        return done
    cells = F.array(*[
        F.when(F.col(c).isNotNull() & _in_range(c, b),
               F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")))
        for c, b in rest.items()
    ])
    counted = df.select(F.inline(F.array_compact(cells))).groupBy("c", "v").count()
    run = Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)

    def rank(which: str):
        return F.create_map(*[F.lit(x) for c, b in rest.items() for x in (c, getattr(b, which) - b.below)])

    upto = F.col("upto")
    placed = counted.withColumn("upto", F.sum("count").over(run))
    rows = (
        placed.withColumn("first", rank("first")[F.col("c")]).withColumn("last", rank("last")[F.col("c")])
        .groupBy("c")
        .agg(F.min(F.when(upto > F.col("first"), F.col("v"))).alias("a"),
             F.min(F.when(upto > F.col("last"), F.col("v"))).alias("b"))
        .collect()
    )
    return done | {r["c"]: (r["a"] + r["b"]) / 2 for r in rows}

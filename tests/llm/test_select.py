"""Sharding, mixing and the selections they rest on."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.fixtures import AWKWARD, table, words
from weirgate.llm import mixing, select, shards
from weirgate.workspace import cut_lineage


def docs(n=600):
    rng = random.Random(8)
    return [(i, " ".join(words(rng.randrange(0, 60), i)), "en", f"s{rng.randrange(6) ** 2}", 0) for i in range(n)] \
        + [(None, "same text", "en", None, 0)] * 150 + AWKWARD


@pytest.mark.parametrize("sorted_rows", [100_000, 20])
def test_shards(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(select, "SORTED_ROWS", sorted_rows)  # with 20: many parts, and rows dealt by address
    made = docs()
    got = shards.shard_rows(table(spark, made, clash=True).repartition(5), [1.0] * 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in made)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({d[0] for d in made})
    moved = len({r.doc_id for r in got if r.grown_shard == 7})
    assert 0.05 < moved / 610 < 0.25


def test_weights_and_growth(spark):
    keys = table(spark, [(i, "x") for i in range(3000)])
    four = {r.doc_id: r for r in shards.shard_rows(keys, [1.0, 2.0, 1.0, 0.0]).collect()}
    share = Counter(r.shard for r in four.values())
    assert 0.45 < share[1] / 3000 < 0.55 and share[3] == 0
    five = {r.doc_id: r for r in shards.shard_rows(keys, [1.0, 2.0, 1.0, 0.0, 1.0]).collect()}
    assert all(five[k].shard == four[k].grown_shard for k in four)
    assert shards.shard_rows(table(spark, []), [1.0]).collect() == []


def fill(sizes, weights, share, most):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while True:
        level = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if level[s] >= most * sizes[s]}
        if not full:
            return target | level
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
        if not open_:
            return target


@pytest.mark.parametrize("sorted_rows", [100_000, 10])
def test_mix(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(select, "SORTED_ROWS", sorted_rows)
    made = docs()
    sizes = Counter()
    for d in made:
        sizes[d[3]] += len((d[1] or "").split())
    want = fill(sizes, [5.0, 2.0, 1.0], 1.5, 2.0)
    got = mixing.mix(table(spark, made, clash=True).repartition(5), [5.0, 2.0, 1.0])
    rows = got.collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d[0], len((d[1] or "").split())) for d in made)
    taken, goal, sharing = Counter(), Counter(), Counter()
    for s, t in want.items():
        if sizes[s]:
            goal[round(t, 6)] += t
            sharing[round(t, 6)] += 1
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        if r.size:
            taken[round(r.target, 6)] += r.taken
    assert set(taken) == set(goal)
    assert all(abs(taken[t] - goal[t]) <= 30 * sharing[t] for t in goal), (taken, goal)  # half of the longest row each
    again = mixing.mix(table(spark, made[::-1]).repartition(2), [5.0, 2.0, 1.0]).collect()
    assert Counter(map(str, again)) == Counter(map(str, rows))
    assert mixing.mix(table(spark, []), [1.0]).collect() == []


def test_propensity_changes_who_is_taken(spark):
    rows = [(i, "a b c d", "en", "s", 0) for i in range(2000)]
    df = table(spark, rows).selectExpr("*", "doc_id % 2 * 3 + 1 AS odds")
    got = mixing.mix(df, [1.0], share=0.5, propensity="odds").collect()
    taken = Counter(r.doc_id % 2 for r in got if r.copies)
    assert sum(taken.values()) == 1000 and taken[1] > 1.6 * taken[0]


def test_order_is_exact_and_ties_are_filled(spark, monkeypatch):
    monkeypatch.setattr(select, "SORTED_ROWS", 5)
    rng = random.Random(1)
    rows = [(i, i % 3, rng.choice([7, 7, rng.randrange(1 << 48)]), rng.randrange(1, 5), [50.0, 0.0, 1e9][i % 3]) for i in range(300)]
    df = cut_lineage(spark.createDataFrame(rows, "id long, g int, k long, size long, need double"))
    got = {r.id: r.chosen for r in select.take_in_order(df, "g", "k", "size", "need", ["id"]).collect()}
    for g in range(3):
        filled = 0
        for i, _, _, size, need in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            want = filled + size <= need or (filled < need and need - filled >= size / 2)
            assert got[i] == want
            filled += size

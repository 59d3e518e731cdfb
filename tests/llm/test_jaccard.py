import random
import re
import tracemalloc
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tests.llm.fixtures import AWKWARD, long_text, table, words
from weirgate import workspace
from weirgate.llm import jaccard


def shingle_set(text):
    got = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not got:
        return frozenset()
    return frozenset([tuple(got)] if len(got) < 3 else [tuple(got[i:i + 3]) for i in range(len(got) - 2)])


def brute(rows, percent=90):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), (min(low[find(i)]) if low[find(i)] else None) if sets[i] else r[0])
                   for i, r in enumerate(rows)), key=str)


def mutants(base, n, seed, rate):
    rng = random.Random(seed)
    return [" ".join(f"m{rng.random()}" if rng.random() < rate else w for w in base) for _ in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("percent", [90, 80])
def test_matches_brute_force(spark, percent):
    texts = []
    for seed, (n, rate) in enumerate([(150, .01), (150, .04), (400, .012), (60, .01), (12, .05), (30, .03), (1000, .015)]):
        texts += mutants(words(n, seed, 5000), 25, seed, rate)
    rng = random.Random(3)
    passage = " ".join(words(60, 99))
    texts += [" ".join(words(rng.randrange(1, 30), 200 + i)) + " " + passage for i in range(40)]
    texts += [" ".join(words(rng.randrange(0, 12), 300 + i, 3)) for i in range(60)]
    texts += texts[:40]
    rows = [(1000 + i * 7 % 1009, t) for i, t in enumerate(texts)] + AWKWARD
    want = brute(rows, percent)
    assert got(jaccard.link(table(spark, rows, clash=True).repartition(5), percent=percent)) == want
    assert got(jaccard.link(table(spark, rows), percent=percent, tile=7)) == want


def test_long_text_and_empty_table(spark):
    text = long_text()
    near = text.replace(" w17 ", " other ", 30)
    rows = [(2, near), (1, text), (3, "short text here")]
    assert got(jaccard.link(table(spark, rows))) == brute(rows)
    assert jaccard.link(table(spark, [])).collect() == []


def test_clashing_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_named", lambda sets, sizes, f=jaccard._named: ((d := f(sets, sizes))[0] % 5, d[1]))
    rows = [(i, " ".join(words(40, i % 9, 5000))) for i in range(30)]
    assert len(set(jaccard._named(np.arange(9, dtype=np.uint64), np.ones(9, int))[0])) <= 5
    assert got(jaccard.link(table(spark, rows))) == brute(rows)


def test_boxes_lose_no_pair():
    rng = np.random.default_rng(0)
    limit = jaccard.Threshold(90)
    base = rng.poisson(3, (30, 8)) + rng.choice([0, 0, 300], (30, 8))
    true = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < .1), 0) for _ in range(8)])
    pts, n = np.minimum(true, 255).astype(np.uint8), true.sum(1)  # a byte is too small for some
    tree = {(min(a, b), max(a, b)) for i, j in jaccard.RTree(pts, n).pairs(limit) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    over = jaccard.excess(pts, n)
    want, linked = set(), set()
    for a, b in combinations(range(len(pts)), 2):
        if jaccard.may_link(pts[a], pts[b], n[a], n[b], over[a], over[b], limit):
            want.add((a, b))
        if np.minimum(true[a], true[b]).sum() >= limit.overlap(n[a] + n[b]):
            linked.add((a, b))
    assert tree == want >= linked and len(linked) > 100


def test_a_word_longer_than_a_piece_stays_one(spark):
    blob = "".join(random.Random(9).choices("abcdefGH", k=2_100_000))
    made = [(1, blob), (2, blob.upper()), (3, blob[:-1]), (4, f"a b {blob} c d"), (5, " " * 600_000 + "a b\n" + blob + "\tc d "),
            (6, "x" * (1 << 19)), (7, "x" * (1 << 19) + " "), (8, "x" * ((1 << 19) + 1) + " y")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(table(spark, made)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (3, 4), 5: (3, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8)}


def test_pairs_that_meet_in_many_cells_are_held_once(monkeypatch):
    rng = np.random.default_rng(4)
    base, limit, size = rng.integers(0, 3, jaccard.GROUPS), jaccard.Threshold(80), 120
    vectors = np.clip(base + (rng.random((size, jaccard.GROUPS)) < 0.02), 0, 255).astype(np.uint8)
    n = vectors.sum(1, dtype=np.int64)
    rows = pd.DataFrame({"node": np.arange(size) * 7, "part": np.arange(size) * 7, "tile": 0, "n": n, "point": [v.tobytes() for v in vectors],
                         "cells": [np.delete(np.arange(150), k) for k in range(size)]})
    want = {(7 * i, 7 * j) for i in range(size) for j in range(i + 1, size)
            if jaccard.may_link(vectors[i], vectors[j], n[i], n[j], 0, 0, limit)}
    assert len(want) > 5000
    monkeypatch.setattr(jaccard, "GATHERED", 20_000, raising=False)
    tracemalloc.start()
    got = jaccard._search(limit, False)((0, 0, 0), rows)
    forest = jaccard._search(limit, True)((0, 0, 0), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(map(tuple, got.values.tolist())) == want and len(got) == len(want)
    assert len(forest) == size - 1 and set(map(tuple, forest.values.tolist())) <= want
    assert peak < 12 << 20


def test_linked_sets_share_a_cell_whatever_the_levels():
    rng = np.random.default_rng(11)
    for percent in (50, 80, 90, 100):
        limit, linked = jaccard.Threshold(percent), 0
        for trial in range(40):
            base = rng.integers(0, 1 << 64, int(rng.integers(1, 90)), dtype=np.uint64)
            sets = [np.unique(np.append(base[rng.random(len(base)) > rate], rng.integers(0, 1 << 64, int(rate * len(base)), dtype=np.uint64)))
                    for rate in (0, .02, .05, .05, .1, .2)]
            counts = np.array([len(x) for x in sets])
            owner, cells = jaccard.cell_keys(np.concatenate(sets), counts, limit, rng.integers(0, 1 << trial % 9, 64).astype(np.uint8))
            held = [set(cells[owner == k].tolist()) for k in range(len(sets))]
            for (a, x), (b, y) in combinations(enumerate(sets), 2):
                common = len(np.intersect1d(x, y))
                if len(x) and len(y) and set(x.tolist()) != set(y.tolist()) and 100 * common >= percent * (len(x) + len(y) - common):
                    assert held[a] & held[b]
                    linked += 1
        assert linked > 100 or percent == 100


def test_a_passage_that_many_texts_share_makes_no_pairs(spark, monkeypatch):
    """Unlike texts with common passages were compared with each other, and their vectors moved for it, once per cell."""
    met = []
    search = jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda members, *rest: (met.append(members.count()), search(members, *rest))[1])
    passages = [" ".join(words(8, 700 + k, 10 ** 6)) for k in range(5)]
    rows = [(i, " ".join(words(60, i, 10 ** 6)) + " " + " ".join(passages)) for i in range(300)]
    rows += [(1000 + i, text + " end") for i, (_, text) in enumerate(rows[:20])]
    assert got(jaccard.link(table(spark, rows))) == brute(rows)
    assert max(met) < 2_000  # shingles of the 20 linked pairs; 300 texts met in each cell of the passages before


def test_tables_between_the_steps_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_root", lambda spark: str(tmp_path))
    rows = [(i, t) for i, t in enumerate(mutants(words(200, 5, 5000), 30, 5, .01) + mutants(words(90, 6, 5000), 30, 6, .02))]
    found = jaccard.link(table(spark, rows))
    left = {f.name for f in tmp_path.iterdir()}
    assert {p.split("/")[-2] for p in found.inputFiles()} <= left and len(left) <= 8  # the answer is read from some of them
    assert got(found) == brute(rows)

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import AWKWARD, long_text, table, words
from weirgate.llm import collocations, multikey
from weirgate.llm.collocations import collocations as find

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def brute(rows, least=30, percent=80, first=2000):
    """rows: doc_id, text, lang."""
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(FOLD)):
            own = re.findall("[^ \t]+", piece)
            n[lang] += len(own)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(own[i:i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i:i + k]] = max(covered[p[i:i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * covered[p] >= percent * a:
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def check(spark, rows, clash=False, parts=4, **options):
    got = find(table(spark, rows, clash).repartition(parts), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(rows, **options)
    return got


def prose(n, seed, size=30, vocabulary=12):
    return [(i, " ".join(w + "., \t\n;"[hash((seed, i, j)) % 40:][:1] for j, w in enumerate(words(size, seed * 1000 + i, vocabulary))),
             ["en", "de", None][i % 3], "s", 0) for i in range(n)]


def test_equals_brute_force(spark):
    assert len(check(spark, prose(300, 1, vocabulary=6))) > 100
    check(spark, prose(100, 2, vocabulary=3), least=5, first=7)
    check(spark, prose(60, 3, vocabulary=40), least=2, percent=60)


def test_long_words_and_texts(spark):
    one, two = "x" * 600_000, "Y" * 300 + " " + "é" * 400
    rows = [(i, f"{one} {two} {one} a b", "en", "s", 0) for i in range(3)] + [(9, long_text(3, 200_000), "en", "s", 0)]
    got = check(spark, rows, least=3)
    assert any(len(r[2]) > 1_000_000 for r in got)


def test_awkward_rows(spark):
    rows = [(*r, *[None] * (5 - len(r))) for r in AWKWARD] + [(None, "A\tb  A b.a b\na", None, None, None)] * 40 \
        + [(1, "été 中文. été 中文 ÉTÉ", "fr", "s", 0)] * 31 + [(2, "one two", "und", "s", 0)] * 30
    assert check(spark, rows, clash=True)
    assert find(table(spark, [])).collect() == [] and find(table(spark, AWKWARD[:3])).collect() == []


def test_hot_pairs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HOT_LEAST", 20)
    monkeypatch.setattr(collocations, "HOT_SHARE", 10)
    monkeypatch.setattr(collocations, "SORTED", 100)
    rows = [(i, f"hot pair w{i % 7} w{i % 3}. cold w{i % 5} hot pair", "en", "s", 0) for i in range(400)]
    check(spark, rows)
    check(spark, prose(200, 4), least=10)


def test_names_that_clash_are_replaced(spark, monkeypatch):
    own = collocations._named
    monkeypatch.setattr(collocations, "_named", lambda data, start, end, seed: own(data, start, end, seed) % (3 if seed < 2 else 1 << 63))
    rows = collocations._rows(table(spark, prose(20, 5)), "lang", "text")
    batches = rows.toArrow().to_batches()
    with pytest.raises(AssertionError):
        names = {}
        for batch in collocations._word_counter(0)(iter(batches)):
            for word, name in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist()):
                assert names.setdefault(name, word) == word


def test_partitions_of_random_windows():
    rng = np.random.default_rng(1)
    for size, vocabulary in ((0, 3), (1, 2), (2000, 3), (5000, 40)):
        windows = rng.integers(1, vocabulary + 1, (size, 4)).astype(np.int64)
        length, weights = rng.integers(1, 5, size), rng.integers(1, 4, size)
        for k in range(4):
            windows[length <= k, k] = 0
        want = Counter()
        for row, n in zip(windows.tolist(), weights.tolist()):
            for k in range(2, 5):
                if row[k - 1]:
                    want[tuple(row[:k] + [0] * (4 - k))] += n
        for least in (1, 30):
            found, n = multikey.equal_partitions(windows, weights, least, range(2, 5))
            assert len(found) == len(n)
            assert dict(zip(map(tuple, found.tolist()), n.tolist())) == {k: v for k, v in want.items() if v >= least}
        merged, n = multikey.merge_equal(windows, weights)
        assert n.sum() == weights.sum() and len(merged) == len({tuple(r) for r in windows.tolist()})

import hashlib
import random

import numpy as np
import pytest

from tests.llm.fixtures import AWKWARD, long_text, table, words
from weirgate.llm import repeats


def brute(rows, length=50):
    first = {}
    texts = [(k, (t or "").encode()) for k, t, *_ in rows]
    for k, b in texts:
        for i in range(len(b) - length + 1) if k is not None else ():
            w = b[i:i + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1) if k is not None else ():
            if first[b[i:i + length]] < k:
                gone[i:i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum()) if len(b) else 0
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(5)
    passages = [" ".join(words(n, 50 + n)) for n in (5, 9, 12, 13, 20, 60, 200)]
    texts = []
    for i in range(60):
        parts = [" ".join(words(rng.randrange(0, 40), i * 100 + j)) for j in range(4)]
        for p in rng.sample(passages, 2):
            cut = p[rng.randrange(0, 9):len(p) - rng.randrange(0, 9)]
            parts.insert(rng.randrange(5), cut)
        texts.append(rng.choice([" ", "", "é"]).join(parts))
    texts += texts[:10] + ["ab" * 200, "ab" * 60, "a" * 500, "a" * 49, "a" * 50, "ü" * 80, "xü" * 90]
    made = [(rng.randrange(10_000), t) for t in texts]
    return made + [(made[3][0], texts[5])] + AWKWARD  # a key with two texts


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"bucket": 40}, {"hot": 3}])
def test_matches_brute_force(spark, limits):
    made = rows()
    assert got(repeats.remove_repeats(table(spark, made, clash=True).repartition(4), **limits)) == brute(made)


def test_other_lengths(spark):
    made = rows()[:30]
    assert got(repeats.remove_repeats(table(spark, made), length=24, prefix=12)) == brute(made, 24)


def test_long_texts_in_pieces(spark):
    text = long_text()
    at = 1_048_576 - 25  # a shared passage across the end of a piece
    passage = " ".join(words(30, 7, 10 ** 9))
    made = [(2, text[:at] + passage + text[at:at + 400_000]), (1, passage), (3, text[at - 500:at + 500]), (4, text[:2_000])]
    assert got(repeats.remove_repeats(table(spark, made))) == brute(made)


def test_empty_table(spark):
    assert repeats.remove_repeats(table(spark, [])).collect() == []


def repetitive():
    """Few rows with very many positions of one rank: a phrase and a run of dots, over and over."""
    phrase = "the same words again and again, until the page is full of them; "
    return [(k, f"{k} " * 20 + phrase * 40 + "." * (350 + k) + f" {k}" * 30) for k in (3, 1, 2)]


@pytest.mark.parametrize("windows", [False, True])
def test_no_task_gets_all_positions_of_a_rank(spark, monkeypatch, windows):
    most, made = 30, repetitive()
    inner = repeats._resolve

    def watched(*args):
        resolve = inner(*args)

        def run(keys, rows):
            assert rows.groupby("rank").size().max() <= most
            return resolve(keys, rows)

        return run

    monkeypatch.setattr(repeats, "_resolve", watched)
    docs = table(spark, made).selectExpr("doc_id AS _key", "xxhash64(doc_id, text) AS _row", "text")
    length, prefix = (50, 20) if windows else (300, 32)
    ranges = repeats.repeated_ranges([(docs, None)], length, prefix, windows, bucket=10, hot=most).collect()
    first = [r._row for r in docs.filter("_key = 1").collect()]
    assert ranges and not {r._row for r in ranges} & set(first)
    assert got(repeats.remove_repeats(table(spark, made), bucket=10, hot=most)) == brute(made)

import random
import re

import numpy as np

from tests.llm.fixtures import AWKWARD, long_text, table, words
from weirgate.llm import decontaminate as d

ITEMS = [(0, " ".join(words(38, 900, 10 ** 6))), (1, " ".join(words(20, 901, 10 ** 6))), (2, "alpha beta gamma delta eps zeta"),
         (3, "two words"), (4, None), (5, ""), (None, " ".join(words(25, 902, 10 ** 6))), (0, " ".join(words(30, 903, 10 ** 6)))]


def clean(text):
    return re.sub(r"[^\w\s]|_", "", text or "").lower().split()


def brute(rows, items, agree=d.AGREE, shortest=d.SHORTEST):
    """Best stretch on every diagonal of every pair, within the reach of a seed that holds whatever the masks."""
    out = {}
    for key, text, *_ in rows:
        x = clean(text)
        for item, other in items:
            y = clean(other)
            if len(y) < shortest:
                continue
            for shift in range(-len(y) + 1, len(x)):
                score = hits = best = best_hits = 0
                for j in range(max(0, -shift), min(len(y), len(x) - shift)):
                    same = x[j + shift] == y[j]
                    score, hits = (score, hits) if score > 0 else (0, 0)
                    score, hits = score + (1 if same else -d.PRICE), hits + same
                    if score > best:
                        best, best_hits = score, hits
                if best_hits >= min(agree, len(y)):
                    out[(key, item)] = max(out.get((key, item), 0), best_hits)
    return out


def leak(item, rate, seed, low=0, high=None):
    rng = random.Random(seed)
    got = ITEMS[item][1].split()[low:high]
    return " ".join(f"x{rng.random()}" if rng.random() < rate else w for w in got)


def test_finds_leaks_and_leaves_the_rest(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        around = [" ".join(words(rng.randrange(30), 10 + i)), " ".join(words(rng.randrange(30), 70 + i))]
        inside = [leak(0, 0, i), leak(0, .04, i), leak(1, .05, i), leak(0, 0, i, 10, 25), leak(0, 0, i, 0, 8), ITEMS[2][1].upper(),
                  "alpha beta gamma delta other zeta", leak(6, 0, i).upper().replace(" ", "!! "), "", "two words"][i % 10]
        rows.append((i, " ".join([around[0], inside, around[1]])))
    rows += [rows[0], (500, long_text() + " " + leak(1, 0, 1) + " " + long_text(2))] + AWKWARD
    got = {(r.doc_id, r.item_id): r.agree for r in d.contaminated(
        table(spark, rows, clash=True).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    want = brute([r for r in rows if r[0] != 500], ITEMS)
    assert {k: v for k, v in got.items() if k[0] != 500} == want
    assert (500, 1) in got
    assert {k[0] for k in want} >= {i for i in range(60) if i % 10 in (0, 3, 5, 7)}
    assert not {k[0] for k in want} & {i for i in range(60) if i % 10 in (4, 6, 8, 9)}


def test_masks_tolerate_replaced_words():
    for mask, span in zip(d.SPACED, d.SPANS):
        w = np.arange(1, span + 1, dtype=np.uint64)
        for skipped in set(range(span)) - set(mask.tolist()):
            other = w.copy()
            other[skipped] = 99
            assert d.seeds(w, np.array([span]), 0, mask, span, False)[1] == d.seeds(other, np.array([span]), 0, mask, span, False)[1]


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    rows = [(i, leak(i % 2, .04, i)) for i in range(20)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    sent = sorted(map(tuple, d.contaminated(table(spark, rows), items).collect()))
    monkeypatch.setattr(d, "SEEDS_SENT", 0)
    assert sorted(map(tuple, d.contaminated(table(spark, rows), items).collect())) == sent


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.contaminated(table(spark, []), items).collect() == []
    assert d.contaminated(table(spark, [(1, ITEMS[0][1])]), items.limit(0)).collect() == []

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import AWKWARD, long_text, table
from weirgate.llm import quality, select


def sample(n=200):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["clear", "plain", "text", "reads", "well"]) for _ in range(30))) for i in range(n)]
    bad = [(n + i, " ".join(rng.choice(["buy", "now", "$$$", "click", "text"]) for _ in range(30))) for i in range(n)]
    return good, bad


def test_weights_tell_target_from_raw(spark):
    good, bad = sample()
    docs = table(spark, good + bad)
    ratio = quality.fit(docs, table(spark, good[:50]))
    got = quality.resample(docs, ratio, 0.5).collect()
    assert sum(r.selected for r in got) == 200
    assert sum(r.selected for r in got if r.doc_id < 200) > 195
    lowest = min(r.score for r in got if r.selected)
    assert all(r.score <= lowest for r in got if not r.selected)


def test_models_count_every_ngram(spark):
    good, bad = sample(20)
    rows = good + bad + AWKWARD
    total = sum(len(w) + max(0, len(w) - 1) for w in ((r[1] or "").split() for r in rows))
    shares = np.exp(quality._model(table(spark, rows).select("text"), 1000, 2))
    assert shares.sum() == pytest.approx(1)
    assert shares.min() * (total + 1000) == pytest.approx(1)  # an empty bucket
    long = np.exp(quality._model(table(spark, [(1, long_text())]).select("text"), 10, 2))
    assert np.allclose(long * (300_000 + 299_999 + 10) % 1, 0, atol=1e-4) or np.allclose(long * 600_009, np.round(long * 600_009))


def test_sampling_follows_the_weights(spark):
    # two words, one twice as likely in the target: Gumbel top-1 of two rows picks it in two of three draws
    rows = [(0, "a"), (1, "b")]
    ratio = np.zeros(quality.BUCKETS)
    _, bucket = quality.hashed_ngrams(np.frombuffer(b"a", np.uint8), np.array([0, 1]), quality.BUCKETS, 1)
    ratio[bucket] = math.log(2)
    won = Counter()
    for i in range(12):
        docs = table(spark, [(100 * i + k, t) for k in range(0, 100, 2) for t in "ab"])
        got = quality.resample(docs, ratio, 0.1, seed=str(i)).collect()
        won.update(r.log_weight > 0 for r in got if r.selected)
    assert 0.5 < won[True] / sum(won.values()) < 0.85


def test_awkward_rows(spark, monkeypatch):
    rows = AWKWARD + [(7, "one two")] * 30
    got = quality.resample(table(spark, rows, clash=True), np.zeros(quality.BUCKETS), 0.4).collect()
    assert len(got) == len(rows) and sum(r.selected for r in got) == int(len(rows) * 0.4)
    assert quality.resample(table(spark, []), np.zeros(quality.BUCKETS), 0.5).collect() == []
    monkeypatch.setattr(select, "SORTED_ROWS", 3)  # the histogram rounds
    narrow = quality.resample(table(spark, rows), np.zeros(quality.BUCKETS), 0.4).collect()
    assert sorted(map(str, narrow)) == sorted(map(str, got))


def test_labelled_rows_are_bounded(spark):
    docs = table(spark, [(i, "x") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    assert quality.labelled(docs, labels).count() == 150
    assert 0 < quality.labelled(docs, labels, rows=20).count() < 60

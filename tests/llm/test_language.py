import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.fixtures import AWKWARD, long_text, table
from weirgate.llm import language
from weirgate.llm.queries import op4_language_id

ROWS = [(i, t, lang) for i, (t, lang) in enumerate([
    ("the cat and the dog sat on the mat with that other thing", "en"), ("this is the way that they went there", "en"),
    ("der hund und die katze sind auf der matte", "de"), ("das ist nicht die schönste straße", "de"),
    ("le chat et le chien sont sur la table", "fr"), ("c'est la même chose que l'été dernier", "fr")] * 5)]


def plain_bits(model_rows, lang, text):
    """Code length by escapes, from plain counts over strings of bytes (all byte pairs are in the tree)."""
    runs = [Counter() for _ in range(4)]
    for t, own in model_rows:
        if own == lang:
            b = b"   " + t.lower().encode()
            for i in range(3, len(b)):
                for k in range(4):
                    runs[k][b[i - k:i + 1]] += 1

    def chance(context, symbol):
        own = {k: v for k, v in runs[len(context)].items() if k[:-1] == context}
        lower = 1 / 256 if not context else None
        total, kinds = sum(own.values()), len(own)
        seen = own.get(context + bytes([symbol]), 0)
        if seen:
            return seen / (total + kinds)
        if lower is None:
            lower = chance(context[1:], symbol)
        return lower * (kinds / (total + kinds) if total else 1)

    b = b"   " + text.lower().encode()
    return sum(-math.log2(chance(b[i - 3:i], b[i])) for i in range(3, len(b)))


def test_code_lengths_are_exact(spark):
    train = [(r[1], r[2]) for r in ROWS[:6] if r[1].isascii()]
    doubled = [(i, t, lang) for i, (t, lang) in enumerate(train * 2)]  # each pair occurs twice, so all are in the tree
    model = language.fit(table(spark, doubled))
    pairs = {bytes(p) for t, _ in train for p in zip(b" " + t.encode(), t.encode())}
    for text in ("the dog sat on the mat", "der hund sat on the table"):
        data = text.encode()
        assert {bytes(p) for p in zip(b" " + data, data)} <= pairs
        got = language.code_lengths(model, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        assert got == pytest.approx([plain_bits(train * 2, lang, text) for lang in model.langs], rel=1e-4)


def test_rows_do_not_touch_each_other(spark):
    model = language.fit(table(spark, ROWS))
    texts = ["the mat", "", "die straße", "x" * 50, "la table"]
    data = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, data)])
    together = language.code_lengths(model, np.frombuffer(b"".join(data), np.uint8), starts)
    for i, d in enumerate(data):
        alone = language.code_lengths(model, np.frombuffer(d, np.uint8), np.array([0, len(d)]))
        assert np.allclose(together[i], alone[0])


def test_predictions_and_awkward_rows(spark):
    rows = ROWS + [(100, "12 34 !!"), (101, long_text())] + AWKWARD
    model = language.fit(table(spark, ROWS))
    got = {r.doc_id: r for r in language.predict(table(spark, rows, clash=True), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in ROWS)
    assert [got[i].lang_pred for i in (100, 900, 901, 902)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[101].lang_pred in model.langs
    empty = language.fit(table(spark, []))
    assert {r.lang_pred for r in language.predict(table(spark, ROWS), empty).collect()} == {"und"}
    assert language.predict(table(spark, []), model).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_tables_need_little_more_than_what_languages_hold():
    rng = np.random.default_rng(5)
    width, langs = 1201, 4
    common = np.sort(rng.choice(100 * 256, width - 1, replace=False))
    ids = np.zeros(1 << 16, np.int16)
    ids[common] = np.arange(1, width)
    left, right = rng.integers(1, width, (2, 20_000))
    codes = np.unique(rng.integers(0, langs, 20_000) * width * width + left * width + right)
    pairs = np.unique(rng.integers(0, langs, 20_000) * 65536 + rng.choice(common, 20_000))
    model = language.Model(list("abcd"), ids, common, (pairs, np.ones(len(pairs), np.int32)), (codes, np.ones(len(codes), np.int32)))
    tracemalloc.start()
    model.tables()
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    whole = width * width * langs * 4
    assert kept < 0.8 * whole and peak < 1.8 * whole

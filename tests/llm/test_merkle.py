import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import AWKWARD, table, words
from weirgate.llm import merkle
from weirgate.llm.queries import merkle_manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    named = []
    for i, text, lang, source, n in rows:
        lower = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        own = leaf((i, source, lang, n, text))
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        named.append((lang, i, own, leaf((i, source, lang, n, lower)) if hit else own))
    langs = sorted({r[0] for r in named}, key=lambda x: (x is not None, (x or "").encode()))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    trees, order = {}, {}
    for lang in langs:
        order[lang] = sorted((r for r in named if r[0] == lang), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[lang] = levels([r[2] for r in order[lang]])
    top = levels([trees[lang][-1][0] for lang in langs])
    root, found = top[-1][0] if langs else None, []
    for place, lang in enumerate(langs):
        for at, (_, i, own, other) in enumerate(order[lang]):
            siblings, digest = [], other
            for where, tree in ((at, trees[lang]), (place, top)):
                for nodes in tree[:-1]:
                    first = where - where % 8
                    run = nodes[first:first + 8]
                    siblings += run[:where - first] + run[where - first + 1:]
                    digest = h("".join(run[:where - first] + [digest] + run[where - first + 1:]))
                    where //= 8
            found.append((i, own, trees[lang][-1][0], root, h("".join(siblings)), digest, digest == root))
    return found


def same(df, rows):
    def key(r):
        return tuple((v is None, v) for v in map(str, r))
    assert sorted([tuple(r) for r in df.collect()], key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("tall", [1, 2, 4])
def test_equals_brute_force(spark, tall):
    rows = [(i, f"Text {i} of ONE", ["en", "de", "fr", None][0 if i % 3 else i % 4], "s", i) for i in range(700)]
    same(merkle_manifest(table(spark, rows), tall), rows)


def test_many_groups_and_sizes(spark):
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 66] + [1] * 60
    rows = [(100 * g + i, f"Ab{i}", f"l{g:03}", None, None) for g, n in enumerate(sizes) for i in range(n)]
    same(merkle_manifest(table(spark, rows), 1), rows)
    same(merkle_manifest(table(spark, rows), 2), rows)


def test_awkward_rows(spark):
    rows = [(*r, *[None] * (5 - len(r))) for r in AWKWARD] + [(None, "X", None, None, None)] * 3 \
        + [(6, "A b", "de", "s", 3), (6, "A c", "de", "s", 3), (7, " ".join(words(300_000, 1, 9)).upper(), "é", "s", 1)]
    same(merkle_manifest(table(spark, rows, clash=True)), rows)
    same(merkle_manifest(table(spark, rows[:1])), rows[:1])
    assert merkle_manifest(table(spark, [])).collect() == []


def test_one_group_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SLICE_ROWS", 50)
    rows = [(i // 2, "One Text", "en", "s", i % 2) for i in range(900)]
    same(merkle_manifest(table(spark, rows).repartition(6), 2), rows)


def test_any_change_is_found(spark):
    docs = table(spark, [(i, f"text {i}", "en", "s", 1) for i in range(100)])
    found = merkle.manifest(docs, ["doc_id", "text"], {"text": F.concat("text", F.lit("!"))}, F.col("doc_id") % 10 == 0)
    assert {r.doc_id for r in found.filter("NOT verified").collect()} == set(range(0, 100, 10))

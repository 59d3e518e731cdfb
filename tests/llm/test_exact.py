import hashlib
import random
import re
from collections import defaultdict

import pytest

from tests.llm.fixtures import AWKWARD, long_text, table, words
from weirgate.llm import exact


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, n in zip(rows, norm):
        groups[n].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    out, used = [], set()
    for r, n in zip(rows, norm):
        points, none, key = min(groups[n])
        keep = None if none else key
        stays = r[0] == keep and -len(r[1] or "") == points and (n, keep) not in used
        if stays:
            used.add((n, keep))
        out.append((r[0], keep, len(groups[n]), stays, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(9)
    made = []
    for i in range(40):
        text = " ".join(words(rng.randrange(0, 900), i // 2, 50)).replace("w1", ". A")
        made += [(rng.randrange(500), re.sub(" ", lambda m: rng.choice([" ", "\n", "  ", "\t\v"]), text)) for _ in range(3)]
    base = made[60][1]
    made += [(700, base + "x"), (701, "x" + base), (702, base[:500] + "y" + base[500:]), (703, base.replace(" ", " "))]
    return made + [made[0], made[0]] + AWKWARD


@pytest.mark.parametrize("sizes", [{}, {"least": 8, "most": 64}])
def test_matches_brute_force(spark, sizes):
    made = rows()
    got = exact.exact_groups(table(spark, made, clash=True).repartition(4), **sizes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(made)


def test_equal_identifiers_of_different_chunks_are_noticed(spark):
    made = [(i, "abcdefgh"[i:i + 1]) for i in range(8)]
    texts = table(spark, made).selectExpr("array(text) AS _chunks")
    assert exact.verified_attempt(texts, "_chunks", 64) == 0 < exact.verified_attempt(texts, "_chunks", 2)
    with pytest.raises(RuntimeError):
        exact.verified_attempt(texts, "_chunks", 1)
    got = exact.exact_groups(table(spark, made), bits=2).collect()
    assert all(r.group_size == 1 and r.keep_id == r.doc_id for r in got)


def test_chunks_hold_the_text_and_follow_it(spark):
    text = long_text().replace("w1", ". A").replace(" ", "")
    df = spark.createDataFrame([(text,), ("prefix" + text,), ("é" * 20_000,), ("",)], "t string")
    got = df.select("t", exact.chunks(df.t).alias("c")).collect()
    assert all("".join(r.c) == r.t for r in got)
    assert len(set(got[0].c) & set(got[1].c)) > 0.9 * len(got[0].c)  # an insertion moves few cuts
    assert all(len(c) <= exact.CHUNK_MAX for r in got for c in r.c)


def test_empty_table(spark):
    assert exact.exact_groups(table(spark, [])).collect() == []

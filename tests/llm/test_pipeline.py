import random
from collections import Counter

import corpus_pipeline as p
from tests.conftest import SF
from tests.llm.fixtures import AWKWARD, table, words
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import mutants, shingle_set
from weirgate.llm import language, mixing


def test_stages_follow_each_other(spark):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in p.STAGES[:4]:
        docs = stage(spark, before, SF)
        assert docs.schema.simpleString() == before.schema.simpleString(), name
        docs = p.cut_lineage(docs)
        rows = docs.collect()
        old = {r.doc_id: r for r in before.collect()}
        assert all(old[r.doc_id] == r for r in rows)
        if name == "language id":
            assert len(rows) >= 0.98 * len(old)
        if name == "near copies":
            texts = {shingle_set5(r.text) for r in rows}
            assert len(texts) == len(rows) or sum(not shingle_set5(r.text) for r in rows) > 1
        if name == "decontamination":
            bad = {k for k, _ in leaks([(r.doc_id, r.text) for r in old.values()], items)}
            assert {r.doc_id for r in rows} == set(old) - bad and bad
        if name == "mixing":
            assert set(Counter(r.doc_id for r in rows).values()) <= {1, 2}
        before = docs
    last = p.sharding_stage(spark, docs, SF)
    assert last.count() == docs.count()


def shingle_set5(text):
    got = (text or "").lower().split()
    return frozenset([tuple(got)] if got and len(got) < 5 else [tuple(got[i:i + 5]) for i in range(len(got) - 4)])


def test_awkward_rows(spark):
    base = words(200, 1, 10 ** 6)
    near = [(i, t, "en", "s", 0) for i, t in enumerate(mutants(base, 6, 1, .005))]
    plain = [(100 + i, " ".join(words(40, 50 + i, 10 ** 6)), "en", "s", 0) for i in range(20)]
    docs = table(spark, near + plain + [plain[0]] + [(200, "12 34 !!", "en", "s", 0)] + AWKWARD, clash=True)
    spoken = p.language_stage(spark, docs, SF)
    assert spoken.columns == docs.columns
    ids = Counter(r.doc_id for r in spoken.collect())
    assert not {900, 901, 902, 200} & set(ids) and ids[906] == 2 and ids[100] == 2
    single = p.near_copy_stage(spark, docs, SF).collect()
    ids = Counter(r.doc_id for r in single)
    assert sorted(i for i in ids if i is not None and 0 <= i < 6) == [0]
    assert ids[100] == 1 and ids[906] == 0 and ids[-5] == 1 and ids[None] == 0 and ids[900] == ids[901] == 1
    for _, stage in p.STAGES:
        assert stage(spark, table(spark, []), SF).collect() == []


def test_language_rejects_nothing_in_a_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.predict(docs, language.fit(docs)).filter("lang_pred <> 'und'").agg({"bits_per_byte": "max"}).first()[0]
    assert found < 8


def test_rows_go_for_their_own_text_only(spark):
    own = [" ".join(words(60, 900 + i, 10 ** 6)) for i in range(8)]
    near, far = mutants(words(200, 1, 10 ** 6), 3, 1, .005), mutants(words(200, 2, 10 ** 6), 2, 1, .005)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first()[0]
    rows = [(1, near[0]), (None, near[1]), (None, own[0]), (None, own[1]), (None, far[0]), (None, far[1]),
            (7, near[2]), (7, own[2]), (7, own[3]), (7, own[3]), (None, None), (None, "")]
    docs = table(spark, [(k, t, "en", "s", 0) for k, t in rows], clash=True)
    single = p.near_copy_stage(spark, docs, SF)
    assert single.schema == docs.schema
    want = Counter(rows)
    want.subtract([(None, near[1]), (7, near[2]), (7, own[3])])
    assert Counter((r.doc_id, r.text) for r in single.collect()) == +want
    rows = [(None, leak), (None, own[4]), (None, None), (8, leak), (8, own[5]), (9, own[6]), (9, own[6])]
    docs = table(spark, [(k, t, "en", "s", 0) for k, t in rows], clash=True)
    clean = p.decontamination_stage(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in clean) == Counter(x for x in rows if x[1] != leak)


NAMES = ["_high", "_gone", "_copies", "_decided", "_copy", "row", "key", "gone", "found", "bound", "copies", "hash"]


def test_names_of_stages_do_not_clash(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first()[0]
    rows = [(i, " ".join(words(30, i, 10 ** 6)), "en", "s", i) for i in range(12)] + [(50, leak, "en", "s", 1)]
    docs = table(spark, rows)
    for i, name in enumerate(NAMES):
        docs = docs.withColumn(name, docs.doc_id * i)
    for name, stage in p.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        found = got.collect()
        assert found and all(r[name] == r.doc_id * i for r in found for i, name in enumerate(NAMES))


def test_mixing_takes_each_row_by_itself(spark):
    rows = [(None, " ".join(words(10 + i, i)), "en", "a", i) for i in range(100)] \
        + [(7, "one two three", "en", "a", -1)] * 20 + [(i, " ".join(words(30, i)), "en", f"s{i % 3}", i) for i in range(100, 200)]
    docs = table(spark, rows)
    mixed = mixing.mix(docs, p.SOURCE_WEIGHTS)
    want, got = Counter(), Counter()
    for r in mixed.collect():
        want[r.size] += r.copies
    for r in p.mixing_stage(spark, docs, SF).collect():
        got[len(r.text.split())] += 1
        assert tuple(r) in set(rows)
    assert got == +want


def test_without_labels_rows_with_letters_stay(spark):
    rows = [(1, "some text", None, "s", 0), (2, "12 34", None, "s", 0), (3, None, None, "s", 0), (4, "é", None, "s", 0)]
    assert {r.doc_id for r in p.language_stage(spark, table(spark, rows), SF).collect()} == {1, 4}


def test_noise_is_in_no_language(spark):
    rng = random.Random(3)
    prose = [(i, " ".join(words(80, i, 60)), "en", "s", 0) for i in range(200)]
    noise = [(1000 + i, "".join(chr(rng.randrange(0xA1, 0x2000)) for _ in range(400)), "en" if i < 1 else None, "s", 0) for i in range(4)]
    got = {r.doc_id for r in p.language_stage(spark, table(spark, prose + noise), SF).collect()}
    assert set(range(200)) <= got and not {1001, 1002, 1003} & got

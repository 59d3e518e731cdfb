import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.fixtures import AWKWARD, long_text, table
from weirgate.llm import bpe
from weirgate.llm.queries import VOCABULARY, bpe_digests

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, rows):
    out = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table_equals_the_library(spark, vocabulary, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, bpe_digests(docs, vocabulary).collect()), key=str) == want(library, rows)


def test_awkward_rows(spark, vocabulary, library):
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "  \n\n x  y \r\n", "don't we'll 'S 'sx",
             "\x00\x1c\x1f\x85", "ab" * 5000, " " * 5000 + "x", "é" * 3000, "\U0001f600" * 999, "२३४५ ५", long_text()]
    rows = [r[:2] for r in AWKWARD] + list(enumerate(texts))
    docs = table(spark, [(k, t, "en", "s", 0) for k, t in rows], clash=True)
    assert sorted(map(tuple, bpe_digests(docs, vocabulary).collect()), key=str) == want(library, rows)
    coded = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert sorted((str(r.doc_id), r.text) for r in coded.collect()) == sorted((str(k), t or "") for k, t in rows)
    assert {c for c, _ in coded.dtypes} == {"doc_id", "ids", "text"}
    assert bpe_digests(table(spark, []), vocabulary).collect() == []
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [0, 50256])], "k long, ids array<int>"), vocabulary).select("text").collect() \
        == [("",), ("!<|endoftext|>",)]


def test_every_code_point_and_random_texts(vocabulary, library):
    encoder = vocabulary.encoder()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(5)
    texts = ["a" + "a1 !".join(points[i:i + 64]) for i in range(0, len(points), 64)]
    texts += ["".join(rng.choice(["the", " the", "ing", "aa", "'s", " ", "\n", "é", "中", "<|endoftext|>", "Z9", "..."])
                      for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab ") for _ in range(rng.randrange(80))) for _ in range(3000)]
    got = [np.frombuffer(t, np.int32).tolist() for i in range(0, len(texts), 500) for t in encoder.texts(texts[i:i + 500])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def merged(text, merges):
    """Merging by its definition: the earliest merge, leftmost first, until none applies."""
    parts = [bytes([b]) for b in text]
    while True:
        due = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not due:
            return parts
        _, i = min(due)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_random_vocabularies_equal_merging(seed):
    rng, tokens, merges = random.Random(seed), [b"a", b"b", b"c"], []
    while len(merges) < 40:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 9:
            tokens.append(a + b)
            merges.append((a, b))
    ids = {bytes([b]): b for b in range(256)}
    ids |= {a + b: 256 + i for i, (a, b) in enumerate(merges)}
    vocabulary = bpe.Vocabulary.build(ids, merges, {})
    texts = ["".join(rng.choice("aabbc") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    got = vocabulary.encoder().texts(texts)
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [[ids[p] for p in merged(t.encode(), merges)] for t in texts]


def test_memory_stays_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    encoder = bpe.Encoder(vocabulary)
    for i in range(20):
        texts = [f"word{i}x{j} " + "q" * 100 for j in range(30)]
        assert [np.frombuffer(t, np.int32).tolist() for t in encoder.texts(texts)] == [e.ids for e in library.encode_batch(texts)]
        assert all(len(p) <= bpe.LONGEST_REMEMBERED for p in encoder.known) and len(encoder.apart) <= 50


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))

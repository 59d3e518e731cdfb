"""Byte-pair encoding by a dynamic program over prefixes: every prefix has one possible last token."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Fixed value: how byte-level vocabularies cut a text into pieces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces and token pairs that a worker remembers before it forgets them all, and rows handled at once.
REMEMBERED, ROWS = 1 << 18, 256
LONGEST_REMEMBERED = 64
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others numbered from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SuffixAutomaton:
    """All substrings of the given byte strings. A whole string is the longest substring of its state."""

    def __init__(self) -> None:
        self.go: dict[int, int] = {}      # state * 256 + byte: state
        self.link, self.length, self.bytes_out = [0], [0], [bytearray()]

    def _state(self, length: int, link: int, out: bytearray) -> int:
        self.link.append(link)
        self.length.append(length)
        self.bytes_out.append(out)
        return len(self.link) - 1

    def _set(self, state: int, byte: int, to: int) -> None:
        if state << 8 | byte not in self.go:
            self.bytes_out[state].append(byte)
        self.go[state << 8 | byte] = to

    def _split(self, state: int, byte: int, target: int) -> int:
        """A copy of ``target`` for the substrings that end ``state``'s longest one and ``byte``."""
        copy = self._state(self.length[state] + 1, self.link[target], bytearray(self.bytes_out[target]))
        for b in self.bytes_out[target]:
            self.go[copy << 8 | b] = self.go[target << 8 | b]
        self.link[target] = copy
        while self.go.get(state << 8 | byte) == target:
            self.go[state << 8 | byte] = copy
            if not state:
                break
            state = self.link[state]
        return copy

    def add(self, text: bytes) -> int:
        """Insert a string; its state."""
        last = 0
        for byte in text:
            last = self._extend(last, byte)
        return last

    def _extend(self, last: int, byte: int) -> int:
        target = self.go.get(last << 8 | byte)
        if target is not None:
            whole = self.length[target] == self.length[last] + 1
            return target if whole else self._split(last, byte, target)
        made, state = self._state(self.length[last] + 1, 0, bytearray()), last
        while state << 8 | byte not in self.go:
            self._set(state, byte, made)
            if not state:
                return made
            state = self.link[state]
        target = self.go[state << 8 | byte]
        whole = self.length[target] == self.length[state] + 1
        self.link[made] = target if whole else self._split(state, byte, target)
        return made


@dataclass
class Vocabulary:
    """Tokens and merges of a byte-level vocabulary, and the automaton over its tokens, as arrays."""
    tokens: list[bytes]         # by id; tokens outside the merges are empty
    special: dict[str, int]     # strings that are one token wherever they stand
    left: np.ndarray            # the two parts of a token, -1 for single bytes
    right: np.ndarray
    rank: np.ndarray            # when a token is merged, -1 for single bytes
    states: tuple = ()          # keys and targets of the steps, links, lengths, longest token per state
    shorter: np.ndarray | None = None  # the next shorter token that ends a token
    made: Encoder | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a tokenizer file on the driver.

        A byte-level vocabulary whose tokens have one merge each, later than those of both parts; any other
        kind raises ValueError, since the last token of a prefix is then not certain to be unique.
        """
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        plain = model["type"] == "BPE" and spec["pre_tokenizer"] == spec["pre_tokenizer"] | {
            "type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not any(
                model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if not plain or spec["normalizer"] or odd:
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        letters = byte_letters()
        ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        parts = [[bytes(letters[c] for c in part) for part in m] for m in merges]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls.build(ids, [(a, b) for a, b in parts], special)

    @classmethod
    def build(cls, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]) -> Vocabulary:
        count = 1 + max([*ids.values(), *special.values()])
        tokens = [b""] * count
        for token, i in ids.items():
            tokens[i] = token
        left, right, rank = (np.full(count, -1, np.int64) for _ in range(3))
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("a byte has no token")
        for place, (a, b) in enumerate(merges):
            whole = ids[a + b]
            if rank[whole] >= 0 or max(rank[ids[a]], rank[ids[b]]) >= place or len(a + b) < 2:
                raise ValueError(f"merge {place} repeats a token or comes before its parts")
            left[whole], right[whole], rank[whole] = ids[a], ids[b], place
        for text, i in special.items():
            tokens[i] = text.encode()
        vocabulary = cls(tokens, special, left, right, rank)
        vocabulary._index([i for t, i in ids.items() if len(t) == 1 or rank[i] >= 0])
        return vocabulary

    def _index(self, merged: list[int]) -> None:
        """Build the automaton over the tokens that encode to themselves."""
        pairs = Pairs(self)
        sound = np.zeros(len(self.tokens), bool)
        for i in sorted(merged, key=lambda i: self.rank[i]):
            a, b, when = int(self.left[i]), int(self.right[i]), int(self.rank[i])
            sound[i] = when < 0 or (sound[a] and sound[b] and pairs.apart(a, b, when))
        automaton, state_of = SuffixAutomaton(), {}
        for i in merged:
            if sound[i]:
                state_of[i] = automaton.add(self.tokens[i])
        count = len(automaton.link)
        longest = np.full(count, -1, np.int32)
        self.shorter = np.full(len(self.tokens), -1, np.int32)
        longest[list(state_of.values())] = list(state_of)
        for state in np.argsort(automaton.length, kind="stable").tolist()[1:]:
            above = longest[automaton.link[state]]
            if longest[state] >= 0:
                self.shorter[longest[state]] = above
            else:
                longest[state] = above
        keys = np.fromiter(automaton.go.keys(), np.int64, len(automaton.go))
        targets = np.fromiter(automaton.go.values(), np.int32, len(automaton.go))
        self.states = (keys, targets, np.array(automaton.link, np.int32), np.array(automaton.length, np.int32), longest)

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def encoder(self) -> Encoder:
        """Made once per process."""
        if self.made is None:
            self.made = Encoder(self)
        return self.made


class Pairs:
    """Which tokens can stand side by side: no merge across their border comes first."""

    def __init__(self, v: Vocabulary) -> None:
        self.left, self.right, self.rank = v.left.tolist(), v.right.tolist(), v.rank.tolist()
        whole = np.flatnonzero(v.rank >= 0)
        self.span = len(v.tokens)
        self.merge = dict(zip((v.left[whole] * self.span + v.right[whole]).tolist(), v.rank[whole].tolist()))

    def apart(self, a: int, b: int, end: int = NEVER) -> bool:
        """Whether a merge of ``a``'s right edge with ``b``'s left edge is never due before time ``end``.

        Time runs backwards from both whole tokens. A merge across the border is due while both edges stand; it
        loses against an equal merge that takes the edge on the left away, and wins against one on the right.
        """
        until_a = until_b = end
        merge, rank, span = self.merge, self.rank, self.span
        first = end < NEVER  # the merge that makes the token out of both halves is no obstacle
        while True:
            due = merge.get(a * span + b)
            if due is not None and not first and due < until_a and due <= until_b:
                return False
            first = False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                until_a, a = rank[a], self.right[a]
            else:
                until_b, b = rank[b], self.left[b]


class Encoder:
    """A worker's tables: steps of the automaton, remembered pieces and pairs."""

    def __init__(self, v: Vocabulary) -> None:
        keys, targets, link, length, longest = v.states
        self.go = dict(zip(keys.tolist(), targets.tolist()))
        self.link, self.length, self.longest = link.tolist(), length.tolist(), longest.tolist()
        self.shorter, self.size = v.shorter.tolist(), [len(t) for t in v.tokens]
        self.pairs, self.apart, self.known = Pairs(v), {}, {}
        self.special = v.special
        names = sorted(v.special, key=len, reverse=True)
        self.outside = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pieces = regex.compile(PIECES)

    def learn(self, pieces: set[str]) -> None:
        """Remember the token ids of pieces.

        In the order of their bytes neighbouring pieces share prefixes, and a prefix's last token is found once for all.
        """
        go, link, length, longest = self.go, self.link, self.length, self.longest
        size, shorter, known = self.size, self.shorter, self.apart
        last, states, matches, before = [-1], [0], [0], b""  # per prefix: last token, state and length of the match
        for text, piece in sorted([(p.encode(), p) for p in pieces]):
            same = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                same += 1
            del last[same + 1:], states[same + 1:], matches[same + 1:]
            state, matched, end, before = states[-1], matches[-1], same, text
            for byte in text[same:]:
                end += 1
                step = go.get(state << 8 | byte)
                while step is None:
                    state = link[state]
                    matched = length[state]
                    step = go.get(state << 8 | byte)
                state, matched = step, matched + 1
                token = longest[state] if matched == length[state] else longest[link[state]]
                while (left := last[end - size[token]]) >= 0:
                    pair = left << 32 | token
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        fits = known[pair] = self.pairs.apart(left, token)
                    if fits:
                        break
                    token = shorter[token]
                last.append(token)
                states.append(state)
                matches.append(matched)
            out = []
            while end:
                out.append(last[end])
                end -= size[last[end]]
            self.known[piece] = array("i", out[::-1]).tobytes()

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of whole texts as 32-bit integers."""
        split = [self.outside.split(t) if self.outside and t else [t or ""] for t in texts]
        plain = [[self.pieces.findall(part) for part in parts[::2]] for parts in split]
        found = set()
        for row in plain:
            found.update(*row)
        if len(self.known) + len(found) > REMEMBERED:
            self.known.clear()
        new = found.difference(self.known)
        self.learn(new)
        ids, out = self.known.__getitem__, []
        for row, parts in zip(plain, split):
            coded = b"".join(map(ids, row[0]))
            for name, pieces in zip(parts[1::2], row[1:]):
                coded += array("i", [self.special[name]]).tobytes() + b"".join(map(ids, pieces))
            out.append(coded)
        for piece in new:
            if len(piece) > LONGEST_REMEMBERED:
                del self.known[piece]
        return out


def _lists(values: np.ndarray, counts: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), pa.array(values, pa.int32()))


def _encoder(shared, text: str, packed: bool):
    """A task's rows without the text and with its token ids, in batches of few rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                parts = encoder.texts(rows.column(text).to_pylist())
                ids = np.frombuffer(b"".join(parts), np.int32)
                columns = {c: rows.column(c) for c in rows.schema.names if c != text}
                columns["ids"] = _lists(ids, [len(p) // 4 for p in parts])
                if packed:
                    columns["packed"] = pa.array([np.frombuffer(p, np.int32).astype("<u4").tobytes() for p in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _decoder(shared, ids: str, output: str):
    """A task's rows with the text of their token ids besides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        letters, at = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                texts = []
                for row in rows.column(ids):
                    own = row.values.to_numpy().astype(np.int64) if row.is_valid else np.zeros(0, np.int64)
                    size = at[own + 1] - at[own]
                    place = np.repeat(at[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    texts.append(letters[place].tobytes().decode("utf-8", "replace"))
                columns = {c: rows.column(c) for c in rows.schema.names}
                yield pa.RecordBatch.from_pydict(columns | {output: pa.array(texts, pa.string())})

    return run


def _share(docs: DataFrame, vocabulary: Vocabulary):
    return docs.sparkSession.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", packed: bool = False) -> DataFrame:
    """Token ids of every text: ``key``, ids; with ``packed`` also the ids as little-endian unsigned 32-bit integers.

    A suffix automaton over the vocabulary finds the tokens that end at each byte of a piece, longest first; the
    one that can stand beside the last token of the prefix before it is the last token of this prefix, and only one
    can. Following these tokens backwards gives exactly what merging pairs in their order gives, in time linear in the piece.

    Null and empty texts have no ids. A row depends on its own text alone, so nothing is shuffled; repeated rows and
    null keys are kept as they come, an empty table gives no rows, other columns are ignored.
    """
    return _run(docs, key, text, _encoder(_share(docs, vocabulary), "_text", packed), packed)


def decode(coded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", output: str = "text") -> DataFrame:
    """``coded`` plus the text of its ids, special tokens included; null ids give an empty text, and bytes that are no UTF-8
    the replacement character. A column named ``output`` is replaced."""
    rows = coded.drop(output)
    schema = StructType([*rows.schema.fields, StructField(output, StringType())])
    return rows.mapInArrow(_decoder(_share(coded, vocabulary), ids, output), schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` with packed ids and ``decode`` one after the other in one worker: ``key``, ids, packed, text."""
    shared = _share(docs, vocabulary)
    coded, plain = _encoder(shared, "_text", True), _decoder(shared, "ids", "text")
    return _run(docs, key, text, lambda batches: plain(coded(batches)), True, True)


def _run(docs: DataFrame, key: str, text: str, run, packed: bool, decoded: bool = False) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, ids array<int>" + ", packed binary" * packed + ", text string" * decoded
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)

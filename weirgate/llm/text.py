"""UTF-8 text as numpy arrays, for Arrow tasks: words, hashes and distinct shingles of whole texts."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer row is walked in pieces.
BLOCK = 1 << 19
#: The whitespace bytes 0x20 and 0x09 to 0x0D, as a table over all bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32

ODD = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                   0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def powers(seed: int) -> np.ndarray:
    base = np.full(BLOCK + 2, mix(np.array([seed * 2 + 1], np.uint64))[0] | np.uint64(1), np.uint64)
    base[0] = 1
    return np.cumprod(base)


@cache
def byte_values(seed: int, fold: bool) -> np.ndarray:
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * (ODD + np.uint64(2 * seed)))
    return values[FOLD] if fold else values


def prefix_sums(data: np.ndarray, seed: int = 0, fold: bool = False) -> np.ndarray:
    """Sums of byte values times powers; the hash of any piece follows from two of them."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(byte_values(seed, fold)[data] * powers(seed)[:len(data)], out=sums[1:])
    return sums


def piece_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of pieces of at most BLOCK bytes of data: equal pieces have equal hashes wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(seed)[BLOCK - start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and where each row starts, with the end of the last; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def blocks(ends: np.ndarray, size: int = BLOCK):
    """Row ranges of at most ``size`` bytes; a longer row stands alone."""
    first, rows = 0, len(ends) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, last
        first = last


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many each row has."""
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[ends[1:][ends[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.diff(np.searchsorted(start, ends))


def _long_row(data: np.ndarray):
    """Pieces of a long row, each cut after whitespace; a word longer than a piece comes whole and alone."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(SPACE[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else _word_end(data, end)
        yield data[at:end]
        at = end


def _word_end(data: np.ndarray, at: int) -> int:
    """Where the next whitespace is, or the end."""
    for low in range(at, len(data), BLOCK):
        gaps = np.flatnonzero(SPACE[data[low:low + BLOCK]])
        if len(gaps):
            return low + int(gaps[0])
    return len(data)


def _long_word(word: np.ndarray, fold: bool) -> np.ndarray:
    """The hash of a word of more than BLOCK bytes, from its length and the hashes of its pieces in order."""
    total = np.array([len(word)], np.uint64)
    for low in range(0, len(word), BLOCK):
        part = word[low:low + BLOCK]
        total = mix(total * ODD + piece_hashes(prefix_sums(part, 0, fold), np.array([0]), np.array([len(part)])))
    return total


def word_hashes(data: np.ndarray, ends: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block of rows, and how many each row has. ``fold`` lower-cases A to Z."""
    if len(data) > BLOCK:
        parts = [word_hashes(p, np.array([0, len(p)]), fold)[0] if len(p) <= BLOCK else _long_word(p, fold)
                 for p in _long_row(data)]
        return np.concatenate(parts), np.array([sum(map(len, parts))])
    start, end, counts = spans(data, ends)
    return piece_hashes(prefix_sums(data, 0, fold), start, end), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within rows, and how many each row has; a shorter row is one run."""
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    row_start = np.cumsum(counts) - counts
    out_start = np.cumsum(made) - made
    first = np.repeat(row_start - out_start, made) + np.arange(made.sum())
    length = np.repeat(np.minimum(counts, width), made)
    sums = np.zeros(len(first), np.uint64)
    for k in range(width):
        there = k < length
        sums += np.where(there, words[np.minimum(first + k, max(len(words) - 1, 0))] * PLACES[k], np.uint64(0)) \
            if len(words) else np.uint64(0)
    return mix(sums + length.astype(np.uint64)), made


def distinct_sorted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order, and how many each row has. Sorts in place."""
    ends = np.cumsum(counts)
    for e, c in zip(ends.tolist(), counts.tolist()):
        hashes[e - c:e].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    starts = (ends - counts)[counts > 0]
    fresh[starts] = True
    total = np.concatenate([[0], np.cumsum(fresh)])
    return hashes[fresh], total[ends] - total[ends - counts]


def rows_of(batch: pa.RecordBatch, size: int = BLOCK, column: str = "text"):
    """Blocks of a batch: first row, last row, their bytes and row starts."""
    data, ends = utf8(batch.column(column))
    for first, last in blocks(ends, size):
        yield first, last, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]


def text_blocks(column: pa.Array, size: int = BLOCK):
    """Blocks of a text column: bytes and row starts."""
    data, ends = utf8(column)
    for first, last in blocks(ends, size):
        yield data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]

"""Multikey three-way quicksort of weighted word windows, all partitions of a round at once in numpy."""

from __future__ import annotations

import numpy as np


def equal_partitions(words: np.ndarray, weights: np.ndarray, least: int, depths: range) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of windows with the summed weight of the windows that begin with them.

    ``words``: a window per row, a word's name per column, 0 where a window has ended. The windows are sorted
    through pointers. A partition is split at a pivot by the word at its depth; the less and the greater part are split
    again by the same word, the equal part holds a prefix, whose count is its weight, and goes on to the next word.
    Partitions lighter than ``least`` can hold no heavier prefix and are abandoned.

    Returns the prefixes whose length is in ``depths`` (rows like those of ``words``, zeros behind) and their counts.
    """
    deepest = words.shape[1]
    found, counts = [np.zeros((0, deepest), words.dtype)], [np.zeros(0, np.int64)]
    pointers = np.arange(len(words))
    part = np.zeros(len(words), np.int64)   # partition of each pointer; pointers lie sorted by it
    depth = np.zeros(1, np.int64)           # word at which a partition is split
    rng = np.random.default_rng(len(words))
    while len(pointers):
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        size = np.diff(begin, append=len(part))
        pivots = words[pointers[begin + (rng.random(len(begin)) * size).astype(np.int64)], depth]
        own = words[pointers, depth[part]]
        pivot = pivots[part]
        side = part * 3 + (own >= pivot) + (own > pivot)  # less, equal, greater
        order = np.argsort(side, kind="stable")
        pointers, side = pointers[order], side[order]
        begin = np.flatnonzero(np.diff(side, prepend=-1))
        size = np.diff(begin, append=len(side))
        weight = np.add.reduceat(weights[pointers], begin)
        code = side[begin]
        equal, at = code % 3 == 1, depth[code // 3]
        ended = equal & (words[pointers[begin], at] == 0)
        heavy = (weight >= least) & ~ended
        length = at + equal
        report = heavy & equal & (length >= depths.start) & (length < depths.stop)
        prefixes = words[pointers[begin[report]]]
        prefixes[np.arange(deepest) >= length[report, None]] = 0
        found.append(prefixes)
        counts.append(weight[report])
        going = heavy & (length < deepest)
        pointers = pointers[np.repeat(going, size)]
        part, depth = np.repeat(np.arange(going.sum()), size[going]), length[going]
    return np.concatenate(found), np.concatenate(counts)


def merge_equal(words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows made one with their weights summed, in time that a single sort takes.

    Windows are brought together by a hash and compared in full with the first of their hash; those that differ from it
    stay apart, so nothing is merged wrongly.
    """
    if not len(words):
        return words, weights
    mixed = np.zeros(len(words), np.uint64)
    for column in range(words.shape[1]):
        mixed = (mixed ^ words[:, column].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    mixed, words, weights = mixed[order], words[order], weights[order]
    fresh = np.ones(len(words), bool)
    fresh[1:] = (mixed[1:] != mixed[:-1]) | (words[1:] != words[:-1]).any(1)
    begin = np.flatnonzero(fresh)
    return words[begin], np.add.reduceat(weights, begin)

"""Phrase collocations: phrases counted as equal partitions of sorted suffix pointers, scored at their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm import bloom, multikey
from weirgate.llm.text import BLOCK, ODD, mix, piece_hashes, prefix_sums, rows_of
from weirgate.workspace import broadcast_if_small, cut_lineage

LONGEST, LEAST, PERCENT, FIRST = 4, 30, 80, 2000
NO_LANG = "und"
#: Bytes between words, and those among them that end a piece.
GAPS = np.zeros(256, bool)
GAPS[[ord(c) for c in " \t.,;:!?\n\v\f\r"]] = True
BREAKS = GAPS.copy()
BREAKS[[ord(" "), ord("\t")]] = False
#: Longer words are named by a cryptographic hash: sums of powers can collide on long patterns.
LONG_WORD = 256
#: Words gathered before equal ones are merged in a task, and windows that one sorting task gets on average.
GATHERED, SORTED = 1 << 20, 500_000
#: A leading pair with more than this share of all windows is hot; so there are at most so many of them.
HOT_SHARE, HOT_LEAST = 2_000, 50_000
NAMES = [f"w{i}" for i in range(LONGEST)]


def _named(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit names of the words of a block of at most BLOCK bytes, A to Z as a to z."""
    names = piece_hashes(prefix_sums(data, seed, True), start, end, seed)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        names[i] = _long_name(data[start[i]:end[i]].tobytes(), seed)
    return names


def _long_name(word: bytes, seed: int) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(word.lower(), digest_size=8, salt=bytes([seed])).digest(), "little"))


def _cut(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of a row of at most BLOCK bytes that end behind a gap; a longer word stands alone with one gap."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(GAPS[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else _next_gap(data, end)
        yield at, end
        at = end


def _next_gap(data: np.ndarray, at: int) -> int:
    """Behind the next gap, or the end."""
    for low in range(at, len(data), BLOCK):
        gaps = np.flatnonzero(GAPS[data[low:low + BLOCK]])
        if len(gaps):
            return low + int(gaps[0]) + 1
    return len(data)


def _words(data: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]):
    """Words of a block of rows: starts, ends, row numbers, whether one follows the one before in its piece, names."""
    if len(data) > BLOCK:  # a single long row
        parts = []
        for low, high in _cut(data):
            part = data[low:high]
            if len(part) <= BLOCK:
                s, e, row, joined, names = _words(part, np.array([0, len(part)]), seeds)
            else:  # one word longer than a block, perhaps with one gap behind
                size = len(part) - int(GAPS[part[-1]])
                s, e, row, joined = np.array([0]), np.array([size]), np.array([0]), np.zeros(1, bool)
                names = [np.array([_long_name(part[:size].tobytes(), seed)]) for seed in seeds]
            if len(s):
                parts.append((s + low, e + low, row, joined, names))
        if not parts:
            return _words(data[:0], np.array([0, 0]), seeds)
        start, end, row, joined = (np.concatenate([p[i] for p in parts]) for i in range(4))
        names = [np.concatenate([p[4][i] for p in parts]) for i in range(len(seeds))]
    else:
        inside = ~GAPS[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
        touching = edges[inside[edges] & inside[edges - 1]]  # rows that meet without a gap
        start = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.unique(touching)]))
        end = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.unique(touching)]))
        row = np.searchsorted(ends, start, "right") - 1
        names = [_named(data, start, end, seed) for seed in seeds]
    broken = np.concatenate([[0], np.cumsum(BREAKS[data])])
    joined = np.zeros(len(start), bool)
    joined[1:] = (row[1:] == row[:-1]) & (broken[start[1:]] == broken[end[:-1]])
    return start, end, row, joined, names


def _tokens(batch: pa.RecordBatch, seeds: tuple[int, ...]):
    """Per block of rows: its bytes, starts and ends of the words, the rows, the joins, names with the language in them."""
    tags = batch.column("tag").to_numpy(zero_copy_only=False).view(np.uint64)
    for first, last, data, ends in rows_of(batch):
        start, end, row, joined, names = _words(data, ends, seeds)
        tag = tags[first:last][row]
        names = [mix(n + mix((tag + np.uint64(2 * s + 1)) * ODD)).view(np.int64) for n, s in zip(names, seeds)]
        for n in names:
            n[n == 0] = 1  # 0 is no word
        yield data, start, end, row + first, joined, names


def _word_counter(seed: int):
    """A task's words with their counts. Words are told apart by two names in a task, by their letters after that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            held = {}
            for data, start, end, row, _, (name, other) in _tokens(batch, (seed, seed + 1)):
                order = np.lexsort((other, name))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (np.diff(name[order]) != 0) | (np.diff(other[order]) != 0)
                begin = np.flatnonzero(fresh)
                count = np.diff(begin, append=len(order))
                for i, n in zip(order[begin].tolist(), count.tolist()):
                    pair = (int(name[i]), int(other[i]))
                    seen = held.get(pair)
                    if seen:
                        seen[2] += n
                    else:
                        held[pair] = [int(row[i]), data[start[i]:end[i]].tobytes().lower(), n]
                if len(held) >= GATHERED:
                    yield _word_batch(held, langs)
                    held = {}
            yield _word_batch(held, langs)

    return run


def _word_batch(held: dict, langs: pa.Array) -> pa.RecordBatch:
    rows = list(held.values())
    return pa.RecordBatch.from_arrays([
        langs.take(pa.array([r[0] for r in rows], pa.int64())),
        pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string()),
        pa.array([k[0] for k in held], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "id", "n"])


def _windows(names: np.ndarray, joined: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The window of up to LONGEST words from each word on, 0 where the piece ends or an unknown word comes."""
    out = np.zeros((len(names), LONGEST), np.int64)
    out[:, 0] = np.where(known, names, 0)
    open_ = known.copy()
    for k in range(1, LONGEST):
        open_ = open_[:len(open_)].copy()
        open_[:-k] &= joined[k:] & known[k:]
        open_[len(open_) - k:] = False
        out[:-k, k] = np.where(open_[:-k], names[k:], 0)
    return out


def pair_name(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first.view(np.uint64)) + second.view(np.uint64) * ODD).view(np.int64)


def _pair_counter(seed: int, known):
    """A task's counts of pairs of known words, by the pairs' names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            for _, _, _, _, joined, (names,) in _tokens(batch, (seed,)):
                fine = bloom.holds(known.value, names)
                both = joined[1:] & fine[1:] & fine[:-1]
                gathered.append(pair_name(names[:-1][both], names[1:][both]))
                size += len(gathered[-1])
                if size >= GATHERED:
                    yield _pair_batch(gathered)
                    gathered, size = [], 0
        yield _pair_batch(gathered)

    return run


def _pair_batch(gathered: list[np.ndarray]) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate([np.zeros(0, np.int64), *gathered]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])


def _pointer_maker(seed: int, known, frequent, hot: np.ndarray, buckets: int):
    """A task's windows with their counts and the sorting task they go to.

    A window is routed by its leading pair; those of a hot pair are dealt by all their words.
    """
    def routed(gathered: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate([np.zeros((0, LONGEST), np.int64), *gathered])
        words, n = multikey.merge_equal(every, np.ones(len(every), np.int64))
        pair = pair_name(np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1]))
        spread = np.isin(pair, hot)
        route = pair.copy()
        for column in range(2, LONGEST):
            further = pair_name(route, np.ascontiguousarray(words[:, column]))
            route = np.where(spread, further, route)
        bucket = (mix(route.view(np.uint64)) % np.uint64(buckets)).astype(np.int64) * 2 + spread
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(LONGEST)], pa.array(n)],
            ["bucket", *NAMES, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            for _, _, _, _, joined, (names,) in _tokens(batch, (seed,)):
                fine = bloom.holds(known.value, names)
                linked = np.zeros(len(names), bool)
                linked[1:] = joined[1:] & fine[1:] & fine[:-1]
                at = np.flatnonzero(linked)
                linked[at] = bloom.holds(frequent.value, pair_name(names[at - 1], names[at]))
                windows = _windows(names, linked, fine)
                gathered.append(windows[windows[:, 1] != 0])
                size += len(gathered[-1])
                if size >= GATHERED:
                    yield routed(gathered)
                    gathered, size = [], 0
        yield routed(gathered)

    return run


def _sorter(least: int):
    def run(keys: tuple, table: pa.Table) -> pa.Table:
        """Phrases of two words and more of one sorting task; those of hot pairs are counted in parts, whatever their number."""
        words = np.column_stack([table.column(c).to_numpy() for c in NAMES])
        hot = keys[0].as_py() % 2
        found, n = multikey.equal_partitions(words, table.column("n").to_numpy(), 1 if hot else least, range(2, LONGEST + 1))
        return pa.table([*[pa.array(np.ascontiguousarray(found[:, i])) for i in range(LONGEST)], pa.array(n)], [*NAMES, "n"])

    return run


def _rows(docs: DataFrame, lang: str, text: str) -> DataFrame:
    name = F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG))
    return docs.select(name.alias("lang"), F.xxhash64(name).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def word_counts(rows: DataFrame, tries: int = 8) -> tuple[DataFrame, int]:
    """Every word of every language with its count and a name that no other word has, and the seed of the names."""
    for seed in range(0, 2 * tries, 2):
        words = cut_lineage(rows.mapInArrow(_word_counter(seed), "lang string, word string, id long, n long")
                            .groupBy("lang", "word").agg(F.min("id").alias("id"), F.sum("n").alias("n")))
        if not words.groupBy("id").count().filter("count > 1").limit(1).count():
            return words, seed
    raise RuntimeError("words cannot be told apart by their names")


def phrase_counts(rows: DataFrame, words: DataFrame, seed: int, least: int = LEAST) -> DataFrame:
    """Phrases of up to LONGEST words that occur ``least`` times or more: their words' names (w0 to w3, 0 behind), n.

    Words that are too rare end a window, and so do leading pairs that are too rare, found by counting the names of
    pairs; names that clash only let more through. The windows left are the suffix pointers: equal ones are
    merged where they arise, all others meet by their leading pair in one sorting task, which counts the phrases as equal
    partitions. Windows of a hot pair are dealt over all tasks by all of their words, and their partial counts are summed.
    """
    frequent_words = words.filter(F.col("n") >= least)
    known = bloom.shared(frequent_words.select("id"))
    pairs = cut_lineage(rows.mapInArrow(_pair_counter(seed, known), "pair long, n long")
                        .groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    frequent = bloom.shared(pairs.select("pair"))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_LEAST, total // HOT_SHARE)
    hot = np.array([r[0] for r in pairs.filter(F.col("n") > limit).select("pair").collect()], np.int64)
    columns = ", ".join(f"{c} long" for c in NAMES)
    pointers = rows.mapInArrow(_pointer_maker(seed, known, frequent, hot, int(total // SORTED) + 1), f"bucket long, {columns}, n long")
    counted = pointers.groupBy("bucket").applyInArrow(_sorter(least), f"{columns}, n long")
    phrases = counted.groupBy(*NAMES).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    none = F.lit(0).cast("long")
    single = frequent_words.select(F.col("id").alias("w0"), none.alias("w1"), none.alias("w2"), none.alias("w3"), "n")
    return cut_lineage(phrases.unionByName(single))


def _part(first: int, last: int) -> list[Column]:
    """The words from ``first`` to ``last`` as a phrase of its own."""
    return [F.col(NAMES[first + i]) if first + i < last else F.lit(0).cast("long") for i in range(LONGEST)]


def _tagged(columns: list[Column], prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, percent: int = PERCENT,
                 first: int = FIRST) -> DataFrame:
    """The ``first`` phrases of two to four words of each language by the score of their weakest cut.

    Texts in lower case of A to Z are split into pieces at ``. , ; : ! ?`` and line ends, pieces at blanks and tabs into words. A
    phrase that occurs ``least`` times or more is a candidate; cut behind its first k words, into parts that
    occur l and r times, it scores floor(2000000 * a / (l + r)), and the lowest of its cuts counts, the first among equals.
    Candidates within a longer candidate that occurs ``percent`` per cent as often or more are dropped.

    Returns lang, rank (from 1), phrase, a, l, r, n (all words of the language), score, by score and a descending, then phrase.
    Null text is empty, a null language is ``und``; repeated rows count each; an empty table gives no rows;
    other columns are ignored. Products are decimals of 38 digits.
    """
    rows = _rows(docs, lang, text)
    words, seed = word_counts(rows)
    counts = phrase_counts(rows, words, seed, least)
    found = counts.filter("w1 <> 0").withColumn("size", F.when(F.col("w2") == 0, 2).when(F.col("w3") == 0, 3).otherwise(4))
    best = _scored(_kept(found, percent), counts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    named = _spelled(best, words, least, first)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(broadcast_if_small(cut_lineage(totals)), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _kept(found: DataFrame, percent: int) -> DataFrame:
    """The candidates that no longer one holds and almost equals in number."""
    inner = []
    for size in range(3, LONGEST + 1):
        longer = found.filter(F.col("size") == size)
        for width in range(2, size):
            inner += [longer.select(*_tagged(_part(at, at + width), "w"), "n") for at in range(size - width + 1)]
    longest = reduce(DataFrame.unionByName, inner).groupBy(*NAMES).agg(F.max("n").alias("longer"))
    return found.join(longest, NAMES, "left").filter(
        F.col("longer").isNull()
        | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("n").cast("decimal(38,0)") * percent)).drop("longer")


def _scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Each candidate with the counts and the score of its weakest cut: w0 to w3, a, l, r, score."""
    cuts = []
    for size in range(2, LONGEST + 1):
        for k in range(1, size):
            cuts.append(found.filter(F.col("size") == size).select(
                *NAMES, F.col("n").alias("a"), F.lit(k).alias("k"), *_tagged(_part(0, k), "l"), *_tagged(_part(k, size), "r")))
    cut = reduce(DataFrame.unionByName, cuts)
    for side in "lr":
        names = [f"{side}{i}" for i in range(LONGEST)]
        cut = cut.join(counts.select(*_tagged([F.col(c) for c in NAMES], side), F.col("n").alias(side)), names).drop(*names)
    wide = cut.withColumn("score", F.expr(
        "CAST(2000000 * CAST(a AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(38,0))) AS BIGINT)"))
    weakest = F.min(F.struct("score", "k", "l", "r"))
    return wide.groupBy(*NAMES, "a").agg(weakest.alias("cut")).select(*NAMES, "a", "cut.l", "cut.r", "cut.score")


def _spelled(best: DataFrame, words: DataFrame, least: int, first: int) -> DataFrame:
    """Language and letters of the phrases that can be among the ``first`` of their language."""
    names = cut_lineage(words.filter(F.col("n") >= least).select("id", "lang", "word"))
    placed = best.join(names.select(F.col("id").alias("w0"), "lang", F.col("word").alias("word0")), "w0")
    top = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    out = placed.withColumn("_place", F.rank().over(top)).filter(F.col("_place") <= first).drop("_place")
    for i in range(1, LONGEST):
        out = out.join(names.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left")
    return out.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(LONGEST)]))

"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm.select import KEY_BITS, hash48
from weirgate.llm.text import FOLD, rows_of, text_blocks

UNKNOWN = "und"
LETTER = r"\p{L}"
PAD = 3  # blanks as context before the first byte
BLANKS = 0x2020
#: Bounds of the model: rows read per language when fitting, languages, bytes of the table of code lengths.
FIT_ROWS, MAX_LANGS, TABLE_BYTES = 5_000, 256, 48 << 20
#: Code lengths looked up at once, bytes of whole rows handled at once, counts gathered before a task hands them on.
STEP_CELLS, STEP_BYTES, GATHERED = 1 << 18, 1 << 16, 1 << 18


@dataclass
class Tables:
    """Bits with a column per language. Two places of the tree that no language holds in this order cost the escape of the
    longer context and the bits of the shorter one, so that only the others need cells of their own."""
    cell: np.ndarray     # per two places the row of their bits, 0 where no language holds them
    held: np.ndarray     # those bits
    opener: np.ndarray   # per place the number of its first byte
    closer: np.ndarray   # and of its second
    escaped: np.ndarray  # by place and first byte of the next pair
    shorter: np.ndarray  # by second byte of a place and next place
    flat: np.ndarray     # by any byte pair


@dataclass
class Model:
    """Frozen counts per language; the table of code lengths is made from them where it is needed."""
    langs: list[str]
    ids: np.ndarray     # per byte pair its place in the tree, 0 where the tree has none
    common: np.ndarray  # the byte pairs in the tree, ascending
    pairs: tuple        # codes (language * 65536 + pair) and counts
    quads: tuple        # codes (language * width * width + place * width + place) and counts
    made: Tables | None = None

    @property
    def width(self) -> int:
        return len(self.common) + 1

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def tables(self) -> Tables:
        """Made once per process."""
        if self.made is None:
            self.made = _tables(self)
        return self.made


def padded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes with blank context before each row: pairs of each byte with its predecessor, the
    pairs two bytes before, and the row starts among them."""
    lengths = np.diff(starts)
    at = np.arange(len(data)) + PAD * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    wide = np.full(len(data) + PAD * len(lengths), ord(" "), np.uint16)
    wide[at] = FOLD[data]
    pair = wide.copy()
    pair[1:] |= wide[:-1] << 8
    return pair[at], pair[at - 2], starts[:-1]


def _tally(codes: np.ndarray, lang: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(lang.astype(np.int64) * span + codes, return_counts=True)


def _counter(ids: np.ndarray | None, width: int):
    """A task's counts of byte pairs, or of pairs of tree pairs, per language."""
    span = width * width if ids is not None else 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for first, last, data, starts in rows_of(batch, STEP_BYTES):
                here, before, _ = padded(data, starts)
                lang = np.repeat(langs[first:last], np.diff(starts))
                codes = here.astype(np.int64)
                if ids is not None:
                    left, right = ids[before].astype(np.int64), ids[here].astype(np.int64)
                    known = (left > 0) & (right > 0)
                    codes, lang = (left * width + right)[known], lang[known]
                gathered.append(_tally(codes, lang, span))
                size += len(gathered[-1][0])
                if size >= GATHERED:
                    yield _summed(gathered)
                    gathered, size = [], 0
        if gathered:
            yield _summed(gathered)

    return run


def _summed(gathered: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    codes, n = (np.concatenate(x) for x in zip(*gathered))
    found, place = np.unique(codes, return_inverse=True)
    total = np.bincount(place, n, len(found)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], ["code", "n"])


def _counts(sample: DataFrame, ids: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sample.mapInArrow(_counter(ids, width), "code long, n long") \
        .groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int32)


def _dense(counts: tuple[np.ndarray, np.ndarray], lang: int, span: int) -> np.ndarray:
    codes, n = counts
    own = codes // span == lang
    out = np.zeros(span, np.float32)
    out[codes[own] % span] = n[own]
    return out


def _escape(counts: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probability of a symbol in a context: its share, or the escape share times the shorter context's."""
    room = np.maximum(total + kinds, 1)
    missed = np.where(total > 0, kinds / room, 1) * lower
    return np.where(counts > 0, counts / room, missed)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_lang: int = FIT_ROWS,
        key: str = "doc_id", max_langs: int = MAX_LANGS, table_bytes: int = TABLE_BYTES) -> Model:
    """Context trees per language, from about ``rows_per_lang`` rows of each, chosen by a hash of the key.

    The trees hold contexts of up to three bytes. Those of two and three bytes are kept
    for the commonest byte pairs, as many as a table of ``table_bytes`` has room for; all others end at one byte.
    Only the ``max_langs`` commonest languages are learned. Rows without text or language are not read.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), hash48(F.col(key), seed="fit").alias("_h")) \
        .filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        none = np.zeros(0, np.int64)
        return Model([], np.zeros(1 << 16, np.int16), none, (none, none), (none, none))
    share = {r["lang"]: min(1.0, rows_per_lang / r["count"]) for r in sizes}
    table = docs.sparkSession.createDataFrame(
        [(name, i, int(share[name] * (1 << KEY_BITS))) for i, name in enumerate(langs)], "lang string, _i int, _cut long")
    sample = rows.join(F.broadcast(table), "lang").filter("_h < _cut").select(F.col("_i").alias("lang"), "text")

    pairs = _counts(sample, None, 0)
    frequent = np.bincount(pairs[0] % (1 << 16), pairs[1], 1 << 16)
    frequent[BLANKS] = np.inf  # the context before the first byte
    width = max(2, min(int((table_bytes / 4 / len(langs)) ** 0.5), 1 + int((frequent > 1).sum())))
    common = np.sort(np.argsort(-frequent, kind="stable")[:width - 1])
    ids = np.zeros(1 << 16, np.int16 if width < 1 << 15 else np.int32)
    ids[common] = np.arange(1, width)
    return Model(langs, ids, common, pairs, _counts(sample, ids, width))


def _tables(model: Model) -> Tables:
    width, langs = model.width, len(model.langs)
    first, second = model.common >> 8, model.common & 255
    begins, opener = np.unique(first, return_inverse=True)
    lasts, closer = np.unique(second, return_inverse=True)
    opener, closer = np.append(0, opener), np.append(0, closer)  # no place is 0
    codes, counts = model.quads
    cells = np.unique(codes % (width * width))
    cell = np.zeros(width * width, np.int32)
    cell[cells] = np.arange(1, len(cells) + 1)
    held = np.zeros((len(cells) + 1, langs), np.float32)
    escaped = np.zeros((width, len(begins), langs), np.float32)
    shorter = np.zeros((len(lasts), width, langs), np.float32)
    flat = np.empty((1 << 16, langs), np.float32)

    for i in range(langs):
        one = _dense(model.pairs, i, 1 << 16).reshape(256, 256)
        single = one.sum(0)
        order0 = _escape(single, single.sum(), (single > 0).sum(), np.full(256, 1 / 256))
        order1 = _escape(one, one.sum(1, keepdims=True), (one > 0).sum(1, keepdims=True), order0[None, :])
        flat[:, i] = -np.log2(order1.reshape(-1))
        own = codes // (width * width) == i
        code, n = codes[own] % (width * width), counts[own].astype(float)
        left, right = code // width, code % width
        two = np.bincount(closer[left] * width + right, n, shorter[..., 0].size)
        last, place = np.divmod(np.flatnonzero(two), width)
        kinds = np.bincount(last * len(begins) + opener[place], minlength=len(lasts) * len(begins)).reshape(len(lasts), -1)
        total = np.bincount(closer[left] * len(begins) + opener[right], n, kinds.size).reshape(kinds.shape)
        order2 = _escape(two.reshape(len(lasts), width)[:, 1:], total[:, opener[1:]], kinds[:, opener[1:]],
                         order1[first, second][None, :])
        shorter[:, 1:, i] = -np.log2(order2)
        context = left * len(begins) + opener[right]
        kinds = np.bincount(context, minlength=escaped[..., 0].size)
        total = np.bincount(context, n, kinds.size)
        escaped[..., i] = -np.log2(_escape(np.zeros(1), total, kinds, np.ones(1))).reshape(width, -1)
        left, right = cells // width, cells % width
        held[1:, i] = escaped[left, opener[right], i] + shorter[closer[left], right, i]
        held[cell[code], i] = -np.log2(n / (total + kinds)[context])
    return Tables(cell, held, opener, closer, escaped, shorter, flat)


def code_lengths(model: Model, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each row under each language."""
    rows, langs = len(starts) - 1, len(model.langs)
    bits = np.zeros((rows, langs))
    if not langs:
        return bits
    tables = model.tables()
    step = max(1, STEP_CELLS // langs)
    here, before, begin = padded(data, starts)
    for low in range(0, len(data), step):
        h, b = here[low:low + step], before[low:low + step]
        left, right = model.ids[b].astype(np.int64), model.ids[h].astype(np.int64)
        cell = tables.cell[left * model.width + right]
        cost = tables.held[cell]
        unseen = np.flatnonzero((cell == 0) & (left > 0) & (right > 0))
        x, y = left[unseen], right[unseen]
        cost[unseen] = tables.escaped[x, tables.opener[y]] + tables.shorter[tables.closer[x], y]
        rare = (left == 0) | (right == 0)
        cost[rare] = tables.flat[h[rare]]
        inside = np.flatnonzero((starts[1:] > low) & (begin < low + step) & (np.diff(starts) > 0))
        bits[inside] += np.add.reduceat(cost, np.maximum(begin[inside] - low, 0), axis=0, dtype=np.float64)
    return bits


def coded(text: Column, model: Model, spark: SparkSession) -> Column:
    """Per text the language whose context tree codes it in the fewest bits, that language's probability if all are
    equally likely beforehand, and the bits per byte. A column, so that rows keep their place and their other columns."""
    shared, langs = spark.sparkContext.broadcast(model), model.langs

    @F.arrow_udf("struct<best:string,sure:double,bits_per_byte:double>")
    def best(texts: pa.Array) -> pa.Array:
        bits, lengths = [np.zeros((0, len(langs)))], [np.zeros(0)]
        for data, starts in text_blocks(texts, STEP_BYTES):
            bits.append(code_lengths(shared.value, data, starts))
            lengths.append(np.diff(starts))
        bits, lengths = np.concatenate(bits), np.concatenate(lengths)
        least = bits.min(1)
        sure = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        return pa.StructArray.from_arrays(
            [pa.array(np.array(langs, object)[bits.argmin(1)], pa.string()), pa.array(sure),
             pa.array(least / np.maximum(lengths, 1))], ["best", "sure", "bits_per_byte"])

    lettered = F.coalesce(text.rlike(LETTER), F.lit(False))
    unknown = F.struct(F.lit(UNKNOWN).alias("best"), F.lit(0.0).alias("sure"), F.lit(0.0).alias("bits_per_byte"))
    return F.when(lettered, best(text)).otherwise(unknown) if langs else unknown


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of each whole text: ``key``, lang_pred, score (0 to 1), bits_per_byte.

    Null text, text without a letter and a model without languages give ``und`` with score 0; equal code lengths
    go to the language that sorts first. A row depends on its own text alone, so nothing is shuffled and
    repeated rows and null keys are kept as they come; an empty table gives no rows; other columns are ignored.
    """
    found = docs.select(F.col(key).alias("_key"), coded(F.col(text), model, docs.sparkSession).alias("_c"))
    return found.select(F.col("_key").alias(key), F.col("_c.best").alias("lang_pred"), F.col("_c.sure").alias("score"),
                        "_c.bits_per_byte")


def held_out(key: Column) -> Column:
    """A quarter of the rows, kept from fitting; a null key is not one of them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))

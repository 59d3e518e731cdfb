"""Exact deduplication over content-defined chunk recipes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.workspace import cut_lineage

WHITESPACE = r"[\x20\x09-\x0D]+"
#: A chunk ends where a sentence mark meets one of a few characters, so that a cut depends on nearby text alone.
BOUNDARY = r"[.!?。！？][A-GЀ-П一-寿]"
CHUNK_MIN, CHUNK_MAX = 1024, 8192
ATTEMPTS = 20


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The text cut after boundaries, each piece of ``least`` to ``most`` characters (the last may be shorter)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most - 2}}}?{BOUNDARY}|.{{1,{most}}}"), F.lit(0))


def _mask(value: Column, bits: int) -> Column:
    return value if bits == 64 else value.bitwiseAND(F.lit((1 << bits) - 1))


def chunk_ids(chunk: Column, attempt: int, bits: int = 64) -> list[Column]:
    """The two halves of a chunk's identifier."""
    return [_mask(F.xxhash64(F.lit(2 * attempt + half), chunk), bits) for half in (0, 1)]


def verified_attempt(texts: DataFrame, column: str, bits: int = 64) -> int:
    """The first hash seed under which no two different chunks of the table share an identifier.

    Each distinct chunk moves once, whole, to be compared byte by byte; from there
    on its 16-byte identifier stands for it.
    """
    for attempt in range(ATTEMPTS):
        distinct = texts.select(F.explode(column).alias("chunk")).distinct()
        high, low = chunk_ids(F.col("chunk"), attempt, bits)
        shared = distinct.select(high.alias("high"), low.alias("low")).groupBy("high", "low").count()
        if shared.filter("count > 1").isEmpty():
            return attempt
    raise RuntimeError("no seed gives every chunk an identifier of its own; use more bits")


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", strip: str | None = WHITESPACE,
    least: int = CHUNK_MIN, most: int = CHUNK_MAX, bits: int = 64,
) -> DataFrame:
    """Groups of equal texts and the row of each that stays.

    Texts are equal when identical after deleting what ``strip`` matches (None:
    nothing). A text is cut into content-defined chunks; chunks become verified
    identifiers, and texts are equal when their ordered identifier lists are.
    Returns per row ``key``, keep_id, group_size, kept, text_sha256. The row with
    the most code points stays, then the smallest key. Null text is empty;
    empty texts equal each other. Null keys sort last; a group without any key
    has a null keep_id. Of rows repeated with key and text, one is kept. An empty
    table gives no rows; other columns are ignored.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    norm = F.regexp_replace(whole, F.lit(strip), F.lit("")) if strip else whole
    cut = docs.select(
        F.col(key).alias("_key"), F.char_length(whole).alias("_points"), norm.alias("_norm")
    ).withColumn("_chunks", chunks(F.col("_norm"), least, most))
    attempt = verified_attempt(cut, "_chunks", bits)
    ids = F.flatten(F.transform("_chunks", lambda c: F.array(*chunk_ids(c, attempt, bits))))
    recipes = cut_lineage(cut.select("_key", "_points", F.sha2("_norm", 256).alias("text_sha256"), ids.alias("_recipe")))
    repeated = recipes.groupBy("_recipe", "_key", "_points", "text_sha256").agg(F.count("*").alias("_copies"))
    first = F.struct(-F.col("_points"), F.col("_key").isNull(), F.col("_key"))
    groups = cut_lineage(recipes.groupBy("_recipe").agg(
        F.min(first).alias("_first"), F.count("*").alias("group_size")
    ).select("_recipe", "group_size", F.col("_first._key").alias("keep_id"),
             (-F.col("_first.col1")).alias("_most")))
    member = cut_lineage(repeated).join(groups, "_recipe")
    stays = F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_points") == F.col("_most"))
    return member.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        F.col("_key").alias(key), "keep_id", "group_size",
        (stays & (F.col("_copy") == 1)).alias("kept"), "text_sha256")

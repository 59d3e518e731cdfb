"""Merkle manifest of a table: one tree per group over row digests, one over the groups' roots, a proof per row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.workspace import broadcast_if_small, cut_lineage

#: Children of a node, and levels of a superblock: the part of a tree that one task reduces (4,096 leaves).
ARITY, HEIGHT = 8, 4
SLICE_ROWS = 100_000
OUTER = "tree string, block long, level int, slot int, digest string"


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns in turn: ``-`` for null, else the value's bytes in UTF-8, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def tree_name(group: Column) -> Column:
    """A group's name, never null; the null group comes first, the others follow by their bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def reduced(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, the given ones first; each run of consecutive nodes becomes one."""
    found = [digests]
    for _ in range(levels):
        below = found[-1]
        found.append([sha256("".join(below[i:i + ARITY]).encode()).hexdigest() for i in range(0, len(below), ARITY)])
    return found


def _local_levels(n: int, tall: int) -> int:
    """Levels inside a superblock of a tree of ``n`` nodes: all of them while there are several superblocks."""
    return min(height(n), tall)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``at``, their place within ``tree`` from 0, and ``n``, how many the tree has.

    Ranges of tree and order are sorted one by one and begin at the count of those before, so a tree that
    holds most of the rows is spread over many tasks. ``nodes`` is a written table; rows equal in tree and ``order`` are
    told apart by their address in it.
    """
    total = nodes.count()
    parts = -(-total // SLICE_ROWS) + 1
    address = {"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")}
    placed = nodes.withColumns(address).repartitionByRange(parts, "tree", *order, "_file", "_at")
    sliced = cut_lineage(placed.withColumn("_slice", F.spark_partition_id()))
    counts = sliced.groupBy("tree", "_slice").count()
    above = Window.partitionBy("tree").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree", "_slice", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("_start"),
        F.sum("count").over(Window.partitionBy("tree")).alias("n"))
    within = F.row_number().over(Window.partitionBy("tree", "_slice").orderBy(*order, "_file", "_at")) - 1
    ranked = sliced.withColumn("_rank", within).join(broadcast_if_small(cut_lineage(starts)), ["tree", "_slice"])
    return ranked.withColumn("at", (F.col("_start") + F.col("_rank")).cast("long")) \
        .drop("_file", "_at", "_slice", "_start", "_rank")


@dataclass(frozen=True)
class Tree:
    """Levels of superblocks: ``tiers[0]`` are the leaves, each further tier the roots of the superblocks below."""
    tiers: list[DataFrame]  # tree, at, n, digest; the first may have more
    tall: int

    @property
    def roots(self) -> DataFrame:
        """One row per tree: tree, digest."""
        return self.tiers[-1].select("tree", "digest")

    def blocks(self, tier: int) -> DataFrame:
        return self.tiers[tier].withColumn("block", F.floor(F.col("at") / ARITY ** self.tall).cast("long"))


def grow(leaves: DataFrame, tall: int = HEIGHT) -> Tree:
    """Reduce superblocks of ``ARITY ** tall`` nodes, tier by tier, until every tree is one node.

    ``leaves`` (tree, at, n, digest) is a written table. A tier holds one row for thousands of the tier below.
    """
    wide = ARITY ** tall

    def root(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("at"), int(rows["n"].iloc[0])
        top = reduced(rows["digest"].tolist(), _local_levels(n, tall))[-1][0]
        return pd.DataFrame({"tree": [keys[0]], "at": [keys[1]], "n": [-(-n // wide)], "digest": [top]})

    tree = Tree([leaves], tall)
    while True:
        blocks = tree.blocks(len(tree.tiers) - 1).select("tree", "block", "at", "n", "digest")
        tree.tiers.append(cut_lineage(
            blocks.groupBy("tree", "block").applyInPandas(root, "tree string, at long, n long, digest string")))
        if (tree.tiers[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return tree


def _runs(levels: list[list[str]], at: int) -> Iterator[tuple[int, list[str]]]:
    """Per level the place of node ``at`` in its run and the run."""
    for nodes in levels[:-1]:
        first = at - at % ARITY
        yield at - first, nodes[first:first + ARITY]
        at //= ARITY


def outer_nodes(tree: Tree, tier: int, above: DataFrame) -> DataFrame:
    """What the nodes of ``tier`` need from outside: the runs on their ways to the root, their own places empty.

    ``above`` holds the same for the tier over it. Each superblock's nodes and the outer nodes it needs are cogrouped.
    The result names the nodes as ``block``, which they are for the tier below.
    """
    tall = tree.tall

    def down(keys: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            rows = rows.sort_values("at")
            levels = reduced(rows["digest"].tolist(), _local_levels(int(rows["n"].iloc[0]), tall))
            further = list(zip(outer["level"] + len(levels) - 1, outer["slot"], outer["digest"]))
            for place, at in enumerate(rows["at"].tolist()):
                own = [(level, slot, None if slot == mine else digest)
                       for level, (mine, run) in enumerate(_runs(levels, place)) for slot, digest in enumerate(run)]
                out += [(keys[0], at, *node) for node in own + further]
        return pd.DataFrame(out, columns=["tree", "block", "level", "slot", "digest"])

    blocks = tree.blocks(tier).select("tree", "block", "at", "n", "digest")
    return cut_lineage(blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(down, OUTER))


def _to_bottom(tree: Tree, above: DataFrame) -> DataFrame:
    """The outer nodes of the superblocks of leaves, from those of the roots."""
    for tier in range(len(tree.tiers) - 2, 0, -1):
        above = outer_nodes(tree, tier, above)
    return above


def manifest(docs: DataFrame, columns: list[str], tampered: dict[str, Column] | None = None, altered: Column | None = None,
             key: str = "doc_id", group: str = "lang", tall: int = HEIGHT) -> DataFrame:
    """Leaf, roots and a checked proof for every row.

    A row's leaf is the digest of ``columns``. Per ``group`` the leaves in the order of ``key`` form a tree, the groups' roots, null
    first, then by bytes, another one. Where ``altered`` holds, the row is digested again with ``tampered`` in
    the place of its columns and folded with the original siblings.

    Returns ``key``, leaf, subroot, root, proof_sha256 (digest of all siblings from the leaf up, left to right; of nothing
    where there are none), folded_root, verified. Texts never move: only digests do, and those are reduced in
    superblocks of ``ARITY ** tall`` leaves that one task holds. A null key comes first and is not altered by a
    condition that is null; rows that share group and key come in the order of their leaves, equal rows in that
    of their addresses. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    leaf = row_digest([F.col(c) for c in columns])
    other = leaf if altered is None else F.when(
        altered, row_digest([(tampered or {}).get(c, F.col(c)) for c in columns])).otherwise(leaf)
    rows = cut_lineage(docs.select(F.col(key).alias("key"), tree_name(F.col(group)).alias("tree"),
                                   leaf.alias("digest"), F.nullif(other, leaf).alias("changed")))
    tree = grow(cut_lineage(numbered(rows, ["key", "digest"])), tall)
    groups = tree.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = grow(cut_lineage(numbered(cut_lineage(groups), ["name"])), tall)
    nothing = docs.sparkSession.createDataFrame([], OUTER)
    over_groups = outer_nodes(top, 0, _to_bottom(top, nothing))
    named = top.tiers[0].select(F.col("name"), F.col("at").alias("block"))
    over_roots = named.join(over_groups, "block").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "level", "slot", "digest")
    outer = _to_bottom(tree, cut_lineage(over_roots))
    leaves = tree.blocks(0).select("tree", "block", "at", "n", "key", "digest", "changed")
    return leaves.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        _fold(tall), f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    ).withColumnRenamed("key", key)


def _fold(tall: int):
    def climb(digest: str, ways: list[tuple[int, list[str]]]) -> str:
        for mine, run in ways:
            digest = sha256("".join([*run[:mine], digest, *run[mine + 1:]]).encode()).hexdigest()
        return digest

    def fold(keys: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Reduce a superblock, join each leaf's proof from it and from the outer nodes, fold altered leaves."""
        names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        if not len(rows):
            return pd.DataFrame(columns=names)
        rows, n = rows.sort_values("at"), int(rows["n"].iloc[0])
        levels = reduced(rows["digest"].tolist(), _local_levels(n, tall))
        ways = []
        for _, run in outer.sort_values(["level", "slot"]).groupby("level"):
            digests = run["digest"].tolist()
            ways.append((next(i for i, d in enumerate(digests) if not isinstance(d, str)), digests))
        within = height(n) - (len(levels) - 1)  # outer levels that belong to this tree
        subroot = climb(levels[-1][0], ways[:within])
        root = climb(subroot, ways[within:])
        beyond = "".join(d for mine, run in ways for i, d in enumerate(run) if i != mine)
        out = []
        for place, (leaf, changed) in enumerate(zip(rows["digest"], rows["changed"])):
            own = list(_runs(levels, place))
            siblings = "".join(d for mine, run in own for i, d in enumerate(run) if i != mine) + beyond
            folded = climb(changed, own + ways) if isinstance(changed, str) else root
            out.append((leaf, subroot, root, sha256(siblings.encode()).hexdigest(), folded, folded == root))
        found = pd.DataFrame(out, columns=names[1:])
        found.insert(0, "key", rows["key"].array)
        return found

    return fold

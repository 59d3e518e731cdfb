"""Tree classifiers on MLlib."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassifier)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.operators.sampling import fold, stratified_fold

# Forest size and limits, live tree limits, offline tree grid.
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 5, "seed": 42}
LIVE_TREE = {"maxDepth": 20, "minInstancesPerNode": 5, "seed": 42}
TREE_GRID = {
    "maxDepth": [10, 20, 30, None],
    "minSamplesSplit": [2, 5, 10],
    "minInstancesPerNode": [1, 2, 5],
    "impurity": ["gini", "entropy"],
}
# MLlib's depth limit stands in for an unlimited depth.
DEPTH_LIMIT = 30


def forest(label: str = "label", **options) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol=label, **{**FOREST, **options})


def tree(label: str = "label", **options) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol="features", labelCol=label, **{**LIVE_TREE, **options})


def tree_candidates(grid: dict | None = None) -> list[dict]:
    """Distinct settings of the grid.

    A leaf size of m makes every split hold 2m rows, so smaller split sizes coincide; the depth limit stands in for None.
    """
    grid = TREE_GRID if grid is None else grid
    seen = {}
    for impurity in grid["impurity"]:
        for depth in grid["maxDepth"]:
            for leaf in grid["minInstancesPerNode"]:
                for split in grid["minSamplesSplit"]:
                    seen[(DEPTH_LIMIT if depth is None else depth, max(split, 2 * leaf), leaf, impurity)] = None
    return [dict(zip(("maxDepth", "minSamplesSplit", "minInstancesPerNode", "impurity"), key)) for key in seen]


def leaf_paths(model: DecisionTreeClassificationModel) -> list[list[int]]:
    """The nodes from the root to each leaf, leaves from left to right as ``leafCol`` numbers them.

    The model's description lists its leaves in that order, indented by depth, which determines the tree.
    """
    depths = [(len(line) - len(line.lstrip())) - 2 for line in model.toDebugString.splitlines() if "Predict:" in line]
    paths, above, fresh = [], [0], 1
    for depth in depths:
        while len(above) <= depth:  # down the left side
            above.append(fresh)
            fresh += 1
        paths.append(list(above))
        above.pop()
        while above and above[-1] < 0:  # both sides are done
            above.pop()
        if above:
            above[-1] = -above[-1] - 1  # its right side comes next
    return [[-n - 1 if n < 0 else n for n in path] for path in paths]


def cut_leaves(paths: list[list[int]], counts: list[list[int]], depth: int, split: int) -> list[int]:
    """The class of each leaf when nodes at ``depth`` or with fewer than ``split`` training rows are not split."""
    held: dict[int, list[int]] = {}
    for path, own in zip(paths, counts):
        for node in path:
            held[node] = [a + b for a, b in zip(held.get(node, [0] * len(own)), own)]
    out = []
    for path in paths:
        stop = next((n for k, n in enumerate(path) if k == depth or sum(held[n]) < split), path[-1])
        out.append(max(range(len(held[stop])), key=lambda c: (held[stop][c], -c)))
    return out


@dataclass
class CutTree:
    """A fitted tree whose leaves answer as the nodes at which a smaller tree would have stopped."""

    tree: DecisionTreeClassificationModel
    leaves: list[int]

    @property
    def depth(self) -> int:
        return self.tree.depth

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        model = self.tree.setFeaturesCol("features").setLeafCol("_leaf").setPredictionCol("_p") \
            .setRawPredictionCol("_raw").setProbabilityCol("_prob")
        answers = F.array(*[F.lit(c) for c in self.leaves])
        return model.transform(df).withColumn(output, F.get(answers, F.col("_leaf").cast("int"))) \
            .drop("_leaf", "_p", "_raw", "_prob")


def _leaf_counts(model: DecisionTreeClassificationModel, df: DataFrame, keys: list[str], label: str) -> list:
    """Rows per leaf and class: few numbers, however many rows."""
    return model.setLeafCol("_leaf").transform(df).groupBy(*keys, "_leaf", label).count().collect()


def _table(rows, leaves: int, classes: int) -> list[list[int]]:
    out = [[0] * classes for _ in range(leaves)]
    for r in rows:
        out[int(r[-3])][int(r[-2])] += r[-1]
    return out


def tune_tree(df: DataFrame, folds: int = 5, candidates: list[dict] | None = None, id_col: str = "flow_id",
              label: str = "label", seed: int = 42, parallelism: int = 8, stratified: bool = False):
    """(best model, [(settings, accuracy)]) by cross-validation over hashed folds, ``stratified`` by class or not.

    Where a split goes depends on the node's own rows alone, so a tree with a depth limit and a least split size is a deeper tree
    cut at those nodes. One fit per leaf size, impurity and fold, as deep as the deepest candidate, scores
    all depths and split sizes, from counts of training and held-out rows per leaf.
    """
    candidates = tree_candidates() if candidates is None else candidates
    candidates = [{"minSamplesSplit": 2, **c} for c in candidates]
    rows = stratified_fold(df, folds, label, id_col, seed, "_fold") if stratified else df.withColumn("_fold", fold(folds, id_col, seed))
    rows = rows.select("features", label, "_fold").persist()
    classes = 1 + int(rows.agg(F.max(label)).first()[0])
    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(candidates):
        groups.setdefault((c["minInstancesPerNode"], c["impurity"]), []).append(i)

    def deep(leaf: int, impurity: str, members: list[int], data: DataFrame) -> DecisionTreeClassificationModel:
        depth = max(candidates[i]["maxDepth"] for i in members)
        return tree(label, minInstancesPerNode=leaf, impurity=impurity, maxDepth=depth).fit(data)

    def score(job) -> dict[int, float]:
        (leaf, impurity), members, f = job
        model = deep(leaf, impurity, members, rows.filter(F.col("_fold") != f))
        paths = leaf_paths(model)
        found = _leaf_counts(model, rows.withColumn("_held", F.col("_fold") == f), ["_held"], label)
        seen, held = (_table([r for r in found if r["_held"] == h], len(paths), classes) for h in (False, True))
        total = max(1, sum(map(sum, held)))
        out = {}
        for i in members:
            answers = cut_leaves(paths, seen, candidates[i]["maxDepth"], candidates[i]["minSamplesSplit"])
            out[i] = sum(h[a] for h, a in zip(held, answers)) / total
        return out

    jobs = [(key, members, f) for key, members in groups.items() for f in range(folds)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        results = list(pool.map(score, jobs))
    scores = [sum(r[i] for r in results if i in r) / folds for i in range(len(candidates))]
    best = max(range(len(candidates)), key=lambda i: scores[i])
    chosen = candidates[best]
    model = deep(chosen["minInstancesPerNode"], chosen["impurity"], [best], rows)
    paths = leaf_paths(model)
    counts = _table(_leaf_counts(model, rows, [], label), len(paths), classes)
    rows.unpersist()
    return CutTree(model, cut_leaves(paths, counts, chosen["maxDepth"], chosen["minSamplesSplit"])), list(zip(candidates, scores))

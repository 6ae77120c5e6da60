"""Forests for labels 0 and 1 whose leaves keep the share of label 1.

Trees are fitted on the label as a number. For labels 0 and 1 the variance is
half the Gini impurity, so cuts are the same, and a leaf's mean is the share of
label 1. Classification trees would merge neighbouring leaves with the same
majority and with them lose the shares that scores and importances rest on.

A forest of few trees is the beginning of one of more trees, and a tree of limited
depth is the top of a deeper one. A search therefore fits the largest forest
once per fold and setting and reads all smaller and shallower ones off its nodes.

Where all distinct binned rows fit one block, trees are grown inside tasks, some
trees each, level by level on histograms; more rows are Spark ML's. Either way a
tree draws Poisson bootstrap weights, and per node a random subset of features.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ensure_checkpoint_dir, run_parallel, scratch_path, ship_package
from .binned import Block, OneBlock, bin_rows, macro_recall, matrix
from .columns import quoted
from .timeorder import fold_test, fold_train

# Memory for the histograms of the nodes that are grown in one pass.
GROW_MB = 1024


# Bins of a feature.
FOREST_BINS = 32
# Trees that a task grows.
TASK_TREES = 8


def subset_size(strategy: str, n: int) -> int:
    """Features that a node may cut."""
    sizes = {"all": n, "sqrt": np.ceil(np.sqrt(n)), "log2": np.log2(max(n, 1)), "onethird": np.ceil(n / 3)}
    return int(min(n, max(1, sizes[strategy]))) if n else 0


def grow_tree(block: Block, n_features: int, n_bins: int, depth: int, subset: int, bootstrap: bool, seed: Sequence[int]) -> tuple[np.ndarray, ...]:
    """Feature (-1 in leaves), last bin on the left, children, share of label 1 and gain of every node of one tree."""
    rng = np.random.Generator(np.random.PCG64(list(seed)))
    weight = rng.poisson(block.count).astype(float) if bootstrap else block.count
    rows = np.flatnonzero(weight > 0)
    bins = (block.keys - np.arange(n_features, dtype=np.int32) * n_bins)[rows]
    weight, positive = weight[rows], weight[rows] * block.label[rows]
    feature, cut, left, right, share, gained = [], [], [], [], [], []
    at, n_nodes, made = np.zeros(len(rows), np.int64), 1, 0
    for level in range(depth + 1):
        total, ones = np.bincount(at, weights=weight, minlength=n_nodes), np.bincount(at, weights=positive, minlength=n_nodes)
        chosen = np.full(n_nodes, -1)
        place, gain = np.zeros(n_nodes, np.int64), np.zeros(n_nodes)
        if level < depth and len(rows) and n_features and n_bins > 1:
            drawn = np.argsort(rng.random((n_nodes, n_features)), axis=1)[:, :subset]
            slots = ((at * subset)[:, None] + np.arange(subset)) * n_bins + np.take_along_axis(bins, drawn[at], axis=1)
            sums = [np.bincount(slots.ravel(), weights=np.repeat(w, subset), minlength=n_nodes * subset * n_bins).reshape(n_nodes, subset, n_bins) for w in (weight, positive)]
            n_left, p_left = (np.cumsum(x, axis=2)[:, :, :-1] for x in sums)
            n_right, p_right = total[:, None, None] - n_left, ones[:, None, None] - p_left
            valid = (n_left > 0) & (n_right > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                better = p_left**2 / n_left + p_right**2 / n_right
            better = np.where(valid, better, -1.0).reshape(n_nodes, -1)
            best = better.argmax(axis=1)
            gain = better[np.arange(n_nodes), best] - ones**2 / total
            cuts = gain > 1e-9
            which, place = np.divmod(best, n_bins - 1)
            chosen = np.where(cuts, drawn[np.arange(n_nodes), which], -1)
        inner = chosen >= 0
        # The children of the next level in order, two by two.
        child = made + n_nodes + 2 * (np.cumsum(inner) - inner)
        feature.append(chosen)
        cut.append(np.where(inner, place, 0))
        left.append(np.where(inner, child, 0))
        right.append(np.where(inner, child + 1, 0))
        share.append(ones / np.maximum(total, 1e-300))
        gained.append(np.where(inner, gain, 0.0))
        if not inner.any():
            break
        stay = inner[at]
        rows, bins, weight, positive, at = rows[stay], bins[stay], weight[stay], positive[stay], at[stay]
        above = bins[np.arange(len(rows)), chosen[at]] > place[at]
        at = 2 * (np.cumsum(inner) - inner)[at] + above
        made, n_nodes = made + n_nodes, 2 * int(inner.sum())
    return tuple(np.concatenate(x) for x in (feature, cut, left, right, share, gained))


class ProbabilityForest:
    """A forest by Spark's parameter names; rows without features split nothing and score the label's mean."""

    def __init__(self, seed: int = 27, numTrees: int = 20, maxDepth: int = 30, featureSubsetStrategy: str = "sqrt", bootstrap: bool = True):
        self.seed, self.numTrees, self.maxDepth = seed, numTrees, maxDepth
        self.featureSubsetStrategy, self.bootstrap = featureSubsetStrategy, bootstrap

    def fit(self, df: DataFrame) -> "ProbabilityForestModel":
        binned = bin_rows(df, max_bins=FOREST_BINS)
        try:
            if binned.n_blocks > 1:
                return self.fit_blocks(df)
            parts = [range(k, min(k + TASK_TREES, self.numTrees)) for k in range(0, self.numTrees, TASK_TREES)]
            grown = binned.each([(None, part) for part in parts], self.grow)
        finally:
            binned.release()
        return ProbabilityForestModel(Nodes.join([tree for part in grown for tree in part], binned.cuts), len(binned.cuts))

    def fit_blocks(self, df: DataFrame) -> "ProbabilityForestModel":
        """Spark ML's forest, for any number of rows."""
        forest = RandomForestRegressor(
            seed=self.seed, numTrees=self.numTrees, maxDepth=self.maxDepth, featureSubsetStrategy=self.featureSubsetStrategy,
            bootstrap=self.bootstrap, maxBins=FOREST_BINS, maxMemoryInMB=GROW_MB,
        )
        model = forest.fit(df)
        return ProbabilityForestModel(Nodes.of(df.sparkSession, model), model.numFeatures, model.featureImportances.toArray())

    def grow(self, part: tuple, source) -> list[tuple[np.ndarray, ...]]:
        """Some trees on the rows before a fold; a table without rows has none."""
        fold, trees = part
        if not isinstance(source, OneBlock):
            return []
        block, n = source.block.before(fold), source.n_features
        size = subset_size(self.featureSubsetStrategy, n)
        return [grow_tree(block, n, source.n_bins, self.maxDepth, size, self.bootstrap, [self.seed, tree]) for tree in trees]


class ProbabilityForestModel:
    """Adds probability (mean share of label 1 over the trees) and prediction columns."""

    def __init__(self, nodes: "Nodes", n_features: int, importances: np.ndarray | None = None):
        self.nodes = nodes
        self.featureImportances = nodes.importances(n_features) if importances is None else importances

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.nodes)

        @pandas_udf("double")
        def score(x):
            import pandas as pd

            nodes = shared.value
            if not len(x) or not len(nodes.root):
                return pd.Series(np.zeros(len(x)))
            values, total = np.stack(x.to_numpy()), np.zeros(len(x))
            for tree in range(0, len(nodes.root), 10):
                total += nodes.shares(values, slice(tree, tree + 10), [1 << 30]).sum(axis=(0, 1))
            return pd.Series(total / len(nodes.root))

        scored = df.withColumn("probability", score(vector_to_array("features")))
        return scored.select(*[quoted(c) for c in df.columns], "probability", (F.col("probability") > 0.5).cast("double").alias("prediction"))


@dataclass
class Nodes:
    """The nodes of all trees in one set of arrays; ``feature`` is -1 in leaves, children are places.

    Values up to the threshold go left. ``gain`` is what a cut gains over all rows.
    """

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    gain: np.ndarray | None = None

    @classmethod
    def join(cls, trees: Sequence[tuple[np.ndarray, ...]], cuts: Sequence[np.ndarray] | None) -> Nodes:
        """Grown trees side by side; thresholds are values of the cut points, or bins without these."""
        if not trees:
            none = np.zeros(0)
            return cls(*[none.astype(int)] * 2, none, *[none.astype(int)] * 2, none, none)
        sizes = np.array([len(tree[0]) for tree in trees])
        root = np.cumsum(sizes) - sizes
        feature, place, left, right, share, gain = (np.concatenate([tree[k] for tree in trees]) for k in range(6))
        offset = np.repeat(root, sizes)
        threshold = place.astype(float)
        if cuts is not None:
            for f, points in enumerate(cuts):
                mine = feature == f
                threshold[mine] = points[place[mine]] if len(points) else 0.0
        return cls(root, feature, threshold, left + offset, right + offset, share, gain)

    def importances(self, n_features: int) -> np.ndarray:
        """Mean over the trees of each feature's share of the tree's gain."""
        total = np.zeros(n_features)
        for lo, hi in zip(self.root, np.append(self.root[1:], len(self.feature))):
            inner = self.feature[lo:hi] >= 0
            mine = np.bincount(self.feature[lo:hi][inner], weights=self.gain[lo:hi][inner], minlength=n_features)
            total += mine / mine.sum() if mine.sum() else 0.0
        return total / total.sum() if total.sum() else total

    @classmethod
    def of(cls, spark, model: RandomForestRegressionModel) -> Nodes:
        """Read from the model's own files, in the shared folder; as large as the model that the driver holds already."""
        folder = scratch_path(spark, "forest")
        model.write().save(folder)
        node = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").select(
            F.col("treeID").alias("tree"), "id", "leftChild", "rightChild", "prediction",
            F.coalesce("split.featureIndex", F.lit(-1)).alias("feature"),
            F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"),
        )
        rows = node.toPandas().sort_values(["tree", "id"])
        tree, number = rows["tree"].to_numpy(), rows["id"].to_numpy()
        # Nodes of a tree are numbered from 0 without gaps.
        root = np.searchsorted(tree, np.arange(tree.max() + 1))
        if (np.arange(len(tree)) - root[tree] != number).any():
            raise ValueError("the model's nodes are not numbered in order")
        leaf = rows["leftChild"].to_numpy() < 0
        child = lambda c: np.where(leaf, 0, rows[c].to_numpy() + root[tree])
        return cls(root, np.where(leaf, -1, rows["feature"].to_numpy()), rows["threshold"].to_numpy(), child("leftChild"), child("rightChild"), rows["prediction"].to_numpy())

    def shares(self, x: np.ndarray, trees: slice, depths: Sequence[int]) -> np.ndarray:
        """Share per (tree, depth, row) if every tree ends at that depth."""
        root = self.root[trees]
        at = np.repeat(root[:, None], len(x), axis=1)
        out = np.zeros((len(root), len(depths), len(x)))
        rows = np.arange(len(x))[None, :]
        for depth in itertools.count():
            for k, limit in enumerate(depths):
                if limit == depth:
                    out[:, k] = self.share[at]
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                for k, limit in enumerate(depths):
                    if limit > depth:
                        out[:, k] = self.share[at]
                break
            if depth == max(depths):
                break
            left = x[rows, np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(left, self.left[at], self.right[at]), at)
        return out


def stage_cells(nodes: Nodes, x: np.ndarray, label: np.ndarray, count: np.ndarray, sizes: Sequence[int], depths: Sequence[int]) -> np.ndarray:
    """Counts [size, depth, label, said] of rows under the first trees, cut at each depth."""
    cells = np.zeros((len(sizes), len(depths), 2, 2))
    total = np.zeros((len(depths), len(x)))
    done = 0
    for k in np.argsort(sizes, kind="stable"):
        while done < sizes[k]:
            stop = min(sizes[k], done + 10)
            total += nodes.shares(x, slice(done, stop), depths).sum(axis=0)
            done = stop
        for d in range(len(depths)):
            cells[k, d] += np.bincount(2 * label + (total[d] / sizes[k] > 0.5), weights=count, minlength=4).reshape(2, 2)
    return cells


def prefix_cells(model: ProbabilityForestModel, df: DataFrame, sizes: Sequence[int], depths: Sequence[int]) -> np.ndarray:
    """Counts [size, depth, label, said] on labelled rows of the forest's first trees, cut at each depth."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model.nodes)
    sizes, depths = list(sizes), list(depths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(sizes), len(depths), 2, 2))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), batch.num_rows, len(batch.column(0)[0]))
                label = batch.column(1).to_numpy(zero_copy_only=False)
                cells += stage_cells(shared.value, x, label, np.ones(len(x)), sizes, depths)
        flat = cells.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "n"])

    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"))
    found = rows.mapInArrow(run, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(len(sizes) * len(depths) * 4)
    for row in found:
        cells[row["place"]] = row["n"]
    return cells.reshape(len(sizes), len(depths), 2, 2)


def shared_scores(defaults: Mapping, folded: DataFrame, grid: Mapping[str, Sequence], combos: Sequence[dict], n_splits: int, parallelism: int = 4) -> dict[tuple[int, int], float | None]:
    """Macro recall by (combination, fold); trees and depths are read off one forest per fold and other setting."""
    groups: dict[tuple, list[int]] = {}
    for number, params in enumerate(combos):
        groups.setdefault(tuple((k, v) for k, v in params.items() if k not in ("numTrees", "maxDepth")), []).append(number)
    sizes = sorted(set(grid.get("numTrees", [defaults["numTrees"]])))
    depths = sorted(set(grid.get("maxDepth", [defaults["maxDepth"]])))
    tasks = [(group, fold) for group in groups for fold in range(n_splits)]

    def forest_of(group) -> ProbabilityForest:
        return ProbabilityForest(**{**defaults, **dict(group), "numTrees": sizes[-1], "maxDepth": depths[-1]})

    def inside(task, source) -> np.ndarray | None:
        """Grow and score the block's rows in one task."""
        group, fold = task
        if not isinstance(source, OneBlock):
            return None
        nodes = Nodes.join(forest_of(group).grow((fold, range(sizes[-1])), source), None)
        block = source.block
        test = block.fold == fold
        bins = (block.keys - np.arange(source.n_features, dtype=np.int32) * source.n_bins)[test]
        return stage_cells(nodes, bins, block.label[test].astype(np.int64), block.count[test], sizes, depths)

    def apart(task) -> np.ndarray:
        group, fold = task
        return prefix_cells(forest_of(group).fit_blocks(fold_train(folded, fold)), fold_test(folded, fold), sizes, depths)

    binned = bin_rows(folded, "test_fold", FOREST_BINS)
    try:
        found = binned.each(tasks, inside) if binned.n_blocks <= 1 else run_parallel(apart, tasks, parallelism)
    finally:
        binned.release()
    out: dict[tuple[int, int], float | None] = {}
    for (group, fold), cells in zip(tasks, found):
        for number in groups[group]:
            size = sizes.index(combos[number].get("numTrees", defaults["numTrees"]))
            depth = depths.index(combos[number].get("maxDepth", defaults["maxDepth"]))
            out[number, fold] = None if cells is None else macro_recall(cells[size, depth])
    return out


class RandomCutForest:
    """Extremely randomised trees: every tree sees all rows and cuts only at thresholds drawn for it.

    Per tree and feature ``cuts`` thresholds are drawn uniformly between the
    feature's least and largest value from a seeded hash; rows are mapped to the
    bins between them and the tree is grown on the bins, with a random subset
    of the features at each node.
    """

    def __init__(self, seed: int = 27, numTrees: int = 10, maxDepth: int = 30, cuts: int = 31, featureSubsetStrategy: str = "sqrt"):
        self.seed, self.numTrees, self.maxDepth, self.cuts, self.featureSubsetStrategy = seed, numTrees, maxDepth, cuts, featureSubsetStrategy

    def draw(self, low: np.ndarray, high: np.ndarray, tree: int) -> list[list[float]]:
        """Ascending distinct thresholds per feature."""
        rng = np.random.Generator(np.random.PCG64([self.seed, tree]))
        share = rng.random((len(low), self.cuts))
        return [np.unique(a + s * (b - a)).tolist() if b > a else [] for a, b, s in zip(low, high, share)]

    def fit(self, df: DataFrame) -> "RandomCutModel":
        rows = df.select(vector_to_array("features").alias("x"), "label")
        n = (rows.select(F.size("x").alias("n")).first() or {"n": 0})["n"]
        edges = rows.agg(*[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(n) for name, f in (("low", F.min), ("high", F.max))]).first()
        low, high = (np.array([edges[f"{name}{k}"] for k in range(n)], float) for name in ("low", "high"))
        drawn = [self.draw(low, high, tree) for tree in range(self.numTrees)]

        def grow(tree: int) -> RandomForestRegressionModel:
            one = RandomForestRegressor(
                numTrees=1, bootstrap=False, maxDepth=self.maxDepth, seed=self.seed + tree, maxBins=self.cuts + 1,
                featureSubsetStrategy=self.featureSubsetStrategy, maxMemoryInMB=GROW_MB,
            )
            return one.fit(_in_bins(df, drawn[tree]).select("features", "label"))

        return RandomCutModel(run_parallel(grow, range(self.numTrees), 4), drawn)


def _in_bins(df: DataFrame, cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Replace the vector by the number of thresholds each value exceeds."""
    x = vector_to_array("features")

    def exceeded(value: Column, thresholds: Sequence[float]) -> Column:
        if not thresholds:
            return F.lit(0.0)
        return F.size(F.filter(F.array(*[F.lit(c) for c in thresholds]), lambda c: value > c)).cast("double")

    return df.withColumn("features", array_to_vector(F.array(*[exceeded(x[k], column) for k, column in enumerate(cuts)])))


class RandomCutModel:
    """Trees on the bins of their own thresholds."""

    def __init__(self, trees: Sequence[RandomForestRegressionModel], drawn: Sequence):
        self.trees, self.drawn = list(trees), list(drawn)

    @property
    def featureImportances(self) -> np.ndarray:
        """Mean of the trees' importances."""
        total = sum(tree.featureImportances.toArray() for tree in self.trees)
        return total / total.sum() if total.sum() else total

    def transform(self, df: DataFrame) -> DataFrame:
        named = df.withColumn("__features", F.col("features")).withColumn("__share", F.lit(0.0))
        for tree, cuts in zip(self.trees, self.drawn):
            scored = tree.setPredictionCol("__one").transform(_in_bins(named.withColumn("features", F.col("__features")), cuts))
            named = scored.withColumn("__share", F.col("__share") + F.col("__one")).drop("__one")
        share = F.col("__share") / len(self.trees)
        keep = [F.col("__features").alias("features") if c == "features" else quoted(c) for c in df.columns]
        return named.select(*keep, share.alias("probability"), (share > 0.5).cast("double").alias("prediction"))

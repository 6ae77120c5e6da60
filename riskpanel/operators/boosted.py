"""Boosted trees for labels 0 and 1 on histograms of gradients.

The loss is logistic and a split's gain is of second order: for sums G of
gradients and H of their derivatives, G^2 / (H + reg) of the sides less that of
the node. A tree of depth d is grown level by level, one histogram per level over
(node, feature, bin). Rows are distinct (bins, label) with their number; equal
rows have equal scores, hence equal gradients. Where the rows fill many blocks
their scores are written to the checkpoint folder every few trees, and a task
adds the trees since then.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ship_package
from .binned import MAX_BINS, Block, bin_rows, bins_of, sum_blocks
from .columns import quoted

# Trees after which the scores of rows in many blocks are written.
WRITE_EVERY = 25


@dataclass
class Tree:
    """A full tree by level order: inner nodes cut (feature, bin), -1 where they end; ``value`` per node."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))


def leaves(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    """Node that every row of a bin matrix reaches within ``depth`` steps."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(depth):
        feature = tree.feature[node]
        if (feature < 0).all():
            break
        right = bins[rows, np.maximum(feature, 0)] > tree.bin[node]
        node = np.where(feature >= 0, 2 * node + 1 + right, node)
    return node


def _gradients(block: Block, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))
    return (p - block.label) * block.count, p * (1.0 - p) * block.count


def gradient_histogram(block: Block, gradients: tuple[np.ndarray, np.ndarray], node: np.ndarray, level: int, width: int) -> np.ndarray:
    """Sums [gradient or derivative, node of the level, key]; rows that ended above the level have none.

    With ``width`` 0 the sums of whole nodes, which is all that a last level needs.
    """
    first, n_nodes = (1 << level) - 1, 1 << level
    here = slice(None) if (node >= first).all() else node >= first
    at = node[here] - first
    if not width:
        return np.stack([np.bincount(at, weights=g[here], minlength=n_nodes) for g in gradients])
    slots = (at[:, None] * width + block.keys[here]).ravel()
    n = block.keys.shape[1]
    sums = [np.bincount(slots, weights=np.repeat(g[here], n), minlength=n_nodes * width) for g in gradients]
    return np.stack(sums).reshape(2, n_nodes, width)


def grow_level(tree: Tree, histogram: np.ndarray, level: int, n_features: int, n_bins: int, reg: float, least: float, shrink: float, last: bool) -> bool:
    """Set the values of a level's nodes and, above the last level, their cuts; whether any node was cut."""
    first = (1 << level) - 1
    sums = histogram if last else histogram.reshape(2, -1, n_features, n_bins)
    total = sums if last else sums[:, :, 0].sum(axis=2)
    tree.value[first : first + len(total[0])] = np.where(total[1] > 0, -shrink * total[0] / (total[1] + reg), 0.0)
    if last:
        return False
    left = np.cumsum(sums, axis=3)[..., :-1]
    right = total[:, :, None, None] - left
    valid = (left[1] >= least) & (right[1] >= least)
    gain = left[0] ** 2 / (left[1] + reg) + right[0] ** 2 / (right[1] + reg) - (total[0] ** 2 / (total[1] + reg))[:, None, None]
    gain = np.where(valid, gain, -np.inf).reshape(len(total[0]), -1)
    best = gain.argmax(axis=1)
    for k in np.flatnonzero(gain[np.arange(len(best)), best] > 1e-12):
        tree.feature[first + k], tree.bin[first + k] = divmod(int(best[k]), n_bins - 1)
    return bool((tree.feature[first : first + len(best)] >= 0).any())


class OneBlockState:
    """Scores of the rows of one block, kept in memory."""

    def __init__(self, block: Block, n_features: int, n_bins: int, depth: int):
        self.block, self.depth, self.width = block, depth, n_features * n_bins
        self.bins = block.keys - np.arange(n_features, dtype=np.int32) * n_bins
        self.score = np.zeros(len(block.label))
        self.gradients = _gradients(block, self.score)

    def histogram(self, tree: Tree, level: int) -> np.ndarray:
        width = self.width if level < self.depth else 0
        return gradient_histogram(self.block, self.gradients, leaves(tree, self.bins, level), level, width)

    def add(self, tree: Tree) -> None:
        self.score += tree.value[leaves(tree, self.bins, self.depth)]
        self.gradients = _gradients(self.block, self.score)


class BlocksState:
    """Scores of the rows of many blocks: written every few trees, with the trees since then."""

    def __init__(self, blocks: RDD, fold: int | None, n_features: int, n_bins: int, depth: int):
        self.held = blocks.map(lambda block: _scored(block.before(fold)))
        self.written: RDD | None = None
        self.trees: list[Tree] = []
        self.n_features, self.n_bins, self.depth = n_features, n_bins, depth

    def _added(self):
        trees, depth, n_bins = list(self.trees), self.depth, self.n_bins

        def add(block: Block) -> Block:
            bins = block.keys - np.arange(block.keys.shape[1], dtype=np.int32) * n_bins
            score = block.score.copy()
            for tree in trees:
                score += tree.value[leaves(tree, bins, depth)]
            return Block(block.keys, block.label, block.count, block.fold, score)

        return add

    def histogram(self, tree: Tree, level: int) -> np.ndarray:
        add, n_bins, width = self._added(), self.n_bins, self.n_features * self.n_bins if level < self.depth else 0

        def job(block: Block) -> np.ndarray:
            block = add(block)
            bins = block.keys - np.arange(block.keys.shape[1], dtype=np.int32) * n_bins
            return gradient_histogram(block, _gradients(block, block.score), leaves(tree, bins, level), level, width)

        return sum_blocks(self.held, job)

    def add(self, tree: Tree) -> None:
        self.trees.append(tree)
        if len(self.trees) < WRITE_EVERY:
            return
        now = self.held.map(self._added()).persist(StorageLevel.MEMORY_AND_DISK)
        now.checkpoint()
        now.count()
        if self.written is not None:
            self.written.unpersist()
        self.held = self.written = now
        self.trees = []

    def release(self) -> None:
        if self.written is not None:
            self.written.unpersist()


def _scored(block: Block) -> Block:
    return Block(block.keys, block.label, block.count, block.fold, np.zeros(len(block.label)))


class BoostedTrees:
    """Rounds, step and depth by the names of Spark's estimator; ``reg`` and ``least`` as in second-order boosting."""

    def __init__(self, maxIter: int = 100, stepSize: float = 0.1, maxDepth: int = 3, seed: int = 27, reg: float = 1.0, least: float = 1.0, max_bins: int = MAX_BINS):
        """``seed`` has no effect, as all rows and features are used. ``least`` is the least H of a side."""
        self.maxIter, self.stepSize, self.maxDepth, self.seed = maxIter, stepSize, maxDepth, seed
        self.reg, self.least, self.max_bins = reg, least, max_bins

    def fit(self, df: DataFrame) -> BoostedTreesModel:
        binned = bin_rows(df, max_bins=self.max_bins)
        try:
            return BoostedTreesModel(binned.each([None], self.boost)[0], binned.cuts, self.maxDepth)
        finally:
            binned.release()

    def fit_folds(self, folded: DataFrame, n_splits: int) -> list[BoostedTreesModel]:
        """A model per expanding fold; the folds share one binning."""
        binned = bin_rows(folded, "test_fold", self.max_bins)
        try:
            return [BoostedTreesModel(trees, binned.cuts, self.maxDepth) for trees in binned.each(range(n_splits), self.boost)]
        finally:
            binned.release()

    def boost(self, fold: int | None, source) -> list[Tree]:
        """The trees of the rows before a fold."""
        n_features, n_bins = source.n_features, source.n_bins
        inside = source.n_blocks == 1 and hasattr(source, "block")
        state = (
            OneBlockState(source.block.before(fold), n_features, n_bins, self.maxDepth) if inside
            else BlocksState(source.blocks, fold, n_features, n_bins, self.maxDepth)
        )
        trees: list[Tree] = []
        try:
            for _ in range(self.maxIter):
                tree = Tree.empty(self.maxDepth)
                for level in range(self.maxDepth + 1):
                    found = state.histogram(tree, level)
                    if np.ndim(found) == 0:  # no rows
                        return trees
                    if not grow_level(tree, found, level, n_features, n_bins, self.reg, self.least, self.stepSize, level == self.maxDepth):
                        break
                trees.append(tree)
                state.add(tree)
        finally:
            if not inside:
                state.release()
        return trees


class BoostedTreesModel:
    """Fitted trees; adds probability and prediction columns."""

    def __init__(self, trees: Sequence[Tree], cuts: Sequence[np.ndarray], depth: int):
        self.trees, self.cuts, self.depth = list(trees), list(cuts), depth

    @property
    def featureImportances(self) -> np.ndarray:
        """Share of all cuts that each feature has."""
        used = np.zeros(len(self.cuts))
        for tree in self.trees:
            np.add.at(used, tree.feature[tree.feature >= 0], 1.0)
        return used / used.sum() if used.sum() else used

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.trees, self.cuts, self.depth))

        @pandas_udf("double")
        def score(x):
            import pandas as pd

            trees, cuts, depth = shared.value
            if not len(x):
                return pd.Series([], dtype=float)
            bins = bins_of(np.stack(x.to_numpy()), cuts)
            total = np.zeros(len(x))
            for tree in trees:
                total += tree.value[leaves(tree, bins, depth)]
            return pd.Series(1.0 / (1.0 + np.exp(-total)))

        scored = df.withColumn("probability", score(vector_to_array("features")))
        return scored.select(*[quoted(c) for c in df.columns], "probability", (F.col("probability") > 0.5).cast("double").alias("prediction"))

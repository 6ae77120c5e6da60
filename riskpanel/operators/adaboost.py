"""AdaBoost on depth-1 trees for labels 0 and 1, algorithms SAMME and SAMME.R.

A stump cuts one feature at one threshold, so what it does to a row's weight
depends only on the row's bin of that feature and its label. The log weight of a
row after any number of rounds is a sum of one table entry per feature, and a
round is one histogram of weights per (feature, bin, label), whose prefix sums
give every cut's sides at once. The best cut is the one with the least weighted
impurity and is always taken, however little it separates the classes. No
per-round copy of the rows is kept and no plan grows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import exp, log

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .binned import MAX_BINS, Block, bin_rows, confusion, macro_recall
from .columns import quoted

# Probabilities are kept this far away from zero before a logarithm is taken.
SMALLEST = 2.220446049250313e-16


@dataclass(frozen=True)
class Stump:
    """One round: a cut, and per side the probability of class 1; ``weight`` is the round's vote."""

    feature: int | None
    threshold: float
    left: float
    right: float
    weight: float = 1.0
    bin: int = 0

    @property
    def cut(self) -> tuple:
        return (self.feature, self.threshold)

    @staticmethod
    def vote(p: float) -> float:
        return 1.0 if p > 0.5 else -1.0

    @staticmethod
    def log_odds(p: float) -> float:
        return log(max(p, SMALLEST)) - log(max(1.0 - p, SMALLEST))


def _sum_over_cuts(x: Column, terms: Sequence[tuple[tuple, float, float]]) -> Column:
    """Sum of (left or right value) over cuts; equal cuts are merged, the tree of additions is balanced."""
    merged: dict[tuple, list[float]] = {}
    for cut, left, right in terms:
        pair = merged.setdefault(cut, [0.0, 0.0])
        pair[0] += left
        pair[1] += right
    parts = []
    for (feature, threshold), (left, right) in merged.items():
        if feature is None:
            parts.append(F.lit(left))
        else:
            parts.append(F.when(x[feature] <= threshold, F.lit(left)).otherwise(F.lit(right)))
    while len(parts) > 1:
        parts = [
            parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)
        ]
    return parts[0] if parts else F.lit(0.0)


def weight_histogram(block: Block, table: np.ndarray, shift: float) -> np.ndarray:
    """Sum of weights per label and key; ``table`` holds log factors per label and key."""
    n = block.keys.shape[1]
    out = np.zeros((2, table.shape[1]))
    for label, rows in enumerate(block.by_label()):
        keys = block.keys[rows]
        weights = block.count[rows] * np.exp(table[label][keys].sum(axis=1) - shift)
        out[label] = np.bincount(keys.ravel(), weights=np.repeat(weights, n), minlength=table.shape[1])
    return out


def best_cut(histogram: np.ndarray, n_features: int, n_bins: int) -> tuple[int | None, int, dict]:
    """Feature and bin of the cut with the least weighted impurity, and the weight per (side, label).

    Ties go to the smaller feature, then threshold. Without two non-empty sides
    or with one class only there is nothing to cut.
    """
    sums = histogram.reshape(2, n_features, n_bins)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums[:, :1].sum(axis=2, keepdims=True) if n_features else np.zeros((2, 1, 1))
    # Added from the other end, not as a difference, which would leave rounding behind.
    right = np.cumsum(sums[:, :, ::-1], axis=2)[:, :, ::-1][:, :, 1:]
    n_left, n_right = left.sum(axis=0), right.sum(axis=0)
    valid = (n_left > 0) & (n_right > 0)
    if not valid.any() or (total <= 0).any():
        return None, 0, {(side, label): float(total[label].sum()) if side == 0 else 0.0 for side in (0, 1) for label in (0, 1)}
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = left[0] * left[1] / n_left + right[0] * right[1] / n_right
    impurity = np.where(valid, impurity, np.inf)
    # Equal impurities may differ in their last digits.
    feature, at = divmod(int(np.flatnonzero(impurity.ravel() <= impurity.min() * (1 + 1e-12))[0]), n_bins - 1)
    exact = {(0, label): float(sums[label, feature, : at + 1].sum()) for label in (0, 1)}
    return feature, at, {**exact, **{(1, label): float(sums[label, feature, at + 1 :].sum()) for label in (0, 1)}}


class AdaBoost:
    def __init__(self, rounds: int = 100, algorithm: str = "SAMME.R", learning_rate: float = 1.0, seed: int = 27, checkpoint_every: int = 100, max_bins: int = MAX_BINS):
        """``seed`` and ``checkpoint_every`` have no effect: a fit draws nothing and keeps no state in rows."""
        if algorithm not in ("SAMME", "SAMME.R"):
            raise ValueError("algorithm is 'SAMME' or 'SAMME.R'")
        self.rounds = rounds
        self.algorithm = algorithm
        self.learning_rate = learning_rate
        self.seed = seed
        self.checkpoint_every = checkpoint_every
        self.max_bins = max_bins

    def fit(self, df: DataFrame) -> "AdaBoostModel":
        binned = bin_rows(df, max_bins=self.max_bins)
        try:
            return AdaBoostModel(binned.each([None], self.boost)[0], self.algorithm)
        finally:
            binned.release()

    def fit_folds(self, folded: DataFrame, n_splits: int) -> list["AdaBoostModel"]:
        """A model per expanding fold; the folds share one binning."""
        binned = bin_rows(folded, "test_fold", self.max_bins)
        try:
            return [AdaBoostModel(stumps, self.algorithm) for stumps in binned.each(range(n_splits), self.boost)]
        finally:
            binned.release()

    def boost(self, fold: int | None, source) -> list[Stump]:
        """The stumps of the rows before a fold, from any source of histograms."""
        n_features, n_bins = source.n_features, source.n_bins
        table, shift = np.zeros((2, n_features * n_bins)), 0.0
        if source.n_blocks == 1 and hasattr(source, "block"):
            held = source.block.before(fold)
            histogram = lambda: weight_histogram(held, table, shift)
        else:
            histogram = lambda: source.total(_weighing(fold, table, shift))
        stumps: list[Stump] = []
        rows = 0.0
        for _ in range(self.rounds):
            found = histogram()
            feature, at, sums = best_cut(found, n_features, n_bins) if np.size(found) > 1 else (None, 0, {(s, c): 0.0 for s in (0, 1) for c in (0, 1)})
            rows = rows or sum(sums.values())
            if not rows:
                break
            threshold = float(source.cuts[feature][at]) if feature is not None else 0.0
            stump, done = self._judge(feature, threshold, at, sums, first=not stumps)
            if stump is not None:
                stumps.append(stump)
            if done:
                break
            factors, mean_after = self._step(stump, sums, rows)
            shift += log(mean_after) if mean_after > 0 else 0.0
            if feature is None:
                table[:, :n_bins] += np.array(factors[0])[:, None]
                continue
            begin = feature * n_bins
            for label in (0, 1):
                table[label, begin : begin + at + 1] += factors[0][label]
                table[label, begin + at + 1 : begin + n_bins] += factors[1][label]
        return stumps

    def _judge(self, feature, threshold, at, sums, first: bool) -> tuple[Stump | None, bool]:
        """The round's stump (or none) and whether boosting ends with it."""
        chance = [
            sums[side, 1] / (sums[side, 0] + sums[side, 1]) if sums[side, 0] + sums[side, 1] > 0 else 0.5
            for side in (0, 1)
        ]
        total = sum(sums[side, label] for side in (0, 1) for label in (0, 1))
        missed = sum(
            sums[side, 0] if Stump.vote(chance[side]) > 0 else sums[side, 1] for side in (0, 1)
        )
        error = missed / total
        stump = Stump(feature, threshold, *chance, bin=at)
        if error <= 0:
            return stump, True
        if self.algorithm == "SAMME.R":
            return stump, False
        if error >= 0.5:
            if first:
                raise ValueError("the first stump is no better than chance")
            return None, True
        return Stump(feature, threshold, *chance, self.learning_rate * log(1.0 / error - 1.0), at), False

    def _step(self, stump: Stump, sums, rows: float) -> tuple[list, float]:
        """Log factors of this round per side and label, and the mean weight after it."""
        factors = []
        for chance in (stump.left, stump.right):
            if self.algorithm == "SAMME.R":
                half = 0.5 * self.learning_rate * Stump.log_odds(chance)
                factors.append((half, -half))
            else:
                says_one = Stump.vote(chance) > 0
                factors.append((stump.weight if says_one else 0.0, 0.0 if says_one else stump.weight))
        after = sum(
            sums[side, label] * exp(factors[side][label]) for side in (0, 1) for label in (0, 1)
        )
        return factors, after / rows

    @classmethod
    def shared_scores(cls, folded: DataFrame, grid: Mapping[str, Sequence], combos: Sequence[dict], n_splits: int) -> dict[tuple[int, int], float | None]:
        """Macro recall by (combination, fold): one fit per fold and setting scores all its numbers of rounds.

        The stumps of fewer rounds are the first ones of more rounds.
        """
        groups: dict[tuple, list[int]] = {}
        for number, params in enumerate(combos):
            groups.setdefault(tuple((k, v) for k, v in params.items() if k != "rounds"), []).append(number)
        most = max(grid.get("rounds", [cls().rounds]))
        bins = {dict(group).get("max_bins", MAX_BINS) for group in groups}
        out: dict[tuple[int, int], float | None] = {}
        for max_bins in bins:
            binned = bin_rows(folded, "test_fold", max_bins)
            fits = [(group, fold) for group in groups if dict(group).get("max_bins", MAX_BINS) == max_bins for fold in range(n_splits)]

            def run(fit, source):
                group, fold = fit
                return cls(**{**dict(group), "rounds": most}).boost(fold, source)

            try:
                for (group, fold), stumps in zip(fits, binned.each(fits, run)):
                    model = AdaBoostModel(stumps, dict(group).get("algorithm", "SAMME.R"))
                    stages = [combos[number].get("rounds", most) for number in groups[group]]
                    cells = binned.total(_testing(fold, model.tables(stages, binned.n_features, binned.n_bins)))
                    for k, number in enumerate(groups[group]):
                        out[number, fold] = macro_recall(cells[k]) if np.ndim(cells) else None
            finally:
                binned.release()
        return out


def _weighing(fold: int | None, table: np.ndarray, shift: float):
    return lambda block: weight_histogram(block.before(fold), table, shift)


def _testing(fold: int, tables: np.ndarray):
    return lambda block: confusion(block, fold, tables)


class AdaBoostModel:
    """Fitted stumps; adds score, prediction and probability columns."""

    def __init__(self, stumps: Sequence[Stump], algorithm: str):
        self.stumps = list(stumps)
        self.algorithm = algorithm

    def _votes(self, stump: Stump) -> tuple[float, float]:
        if self.algorithm == "SAMME":
            return stump.weight * stump.vote(stump.left), stump.weight * stump.vote(stump.right)
        return stump.log_odds(stump.left), stump.log_odds(stump.right)

    def tables(self, stages: Sequence[int], n_features: int, n_bins: int) -> np.ndarray:
        """Votes per key of the first so many stumps, for every stage."""
        out = np.zeros((len(stages), n_features * n_bins))
        for k, stage in enumerate(stages):
            for stump in self.stumps[:stage]:
                left, right = self._votes(stump)
                begin = (stump.feature or 0) * n_bins
                split = begin + n_bins if stump.feature is None else begin + stump.bin + 1
                out[k, begin:split] += left
                out[k, split : begin + n_bins] += right
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        total = sum(s.weight for s in self.stumps) or 1.0
        votes = soft = [(s.cut, *self._votes(s)) for s in self.stumps]
        if self.algorithm == "SAMME":
            soft = [(s.cut, s.weight * (2 * s.left - 1), s.weight * (2 * s.right - 1)) for s in self.stumps]
        x = F.col("__x")
        scored = df.withColumn("__x", vector_to_array("features")).withColumns(
            {"__vote": _sum_over_cuts(x, votes) / F.lit(total), "__soft": _sum_over_cuts(x, soft) / F.lit(total)}
        )
        return scored.select(
            *[quoted(c) for c in df.columns],
            F.col("__vote").alias("score"),
            (F.col("__vote") > 0).cast("double").alias("prediction"),
            (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__soft")))).alias("probability"),
        )

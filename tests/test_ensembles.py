"""Learners on rare targets, on binned rows and on many blocks, against plain numpy versions."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskpanel.operators import adaboost, binned, boosted, forests, models
from riskpanel.operators.adaboost import AdaBoost
from riskpanel.operators.timeorder import expanding_folds, fold_test, fold_train


def frame(spark, x, y):
    rows = [(i, list(map(float, a)), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i bigint, x array<double>, label double")
    return df.select("i", "label", array_to_vector("x").alias("features"))


def table(seed=1, n=400, d=4, share=0.25):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    x[:, 0] = rng.integers(0, 3, n)
    chance = share * (0.3 + (x[:, 1] > 0.4) + 0.8 * (x[:, 0] == 2) * (x[:, 2] < 0))
    return x, (rng.random(n) < chance).astype(int)


@pytest.mark.parametrize("make", [lambda: models.forest(numTrees=5, maxDepth=30, bootstrap=False), lambda: models.unsampled_forest(num_trees=5)])
def test_rare_target_moves_the_probability(spark, make):
    """A feature that moves the rate from 10 to 30 % is used, though both sides say 0."""
    x = [[k % 2] for k in range(400)]
    y = [int(k // 2 % 20 < (6 if k % 2 else 2)) for k in range(400)]
    model = make().fit(frame(spark, x, y))
    assert list(model.featureImportances) == [1.0]
    got = {round(r.score, 6) for r in models.score_rows(model, frame(spark, x, y)).collect()}
    assert got == {0.1, 0.3}


def plain_stumps(x, y, rounds, algorithm):
    """Every middle between two values of every feature, by weighted impurity."""
    w = np.ones(len(y))
    out = []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                sides = [x[:, f] <= cut, x[:, f] > cut]
                sums = [(w[s & (y == 0)].sum(), w[s & (y == 1)].sum()) for s in sides]
                impurity = sum(a * b / (a + b) for a, b in sums)
                if best is None or impurity < best[0] * (1 - 1e-12):
                    best = (impurity, f, cut, [b / (a + b) for a, b in sums])
        _, f, cut, (left, right) = best
        p = np.where(x[:, f] <= cut, left, right)
        weight = 1.0
        if algorithm == "SAMME":
            miss = (p > 0.5) != (y == 1)
            error = (w * miss).sum() / w.sum()
            if error >= 0.5:
                break
            weight = np.log(1 / error - 1)
            w = w * np.exp(weight * miss)
        else:
            w = w * np.exp(-0.5 * (2 * y - 1) * (np.log(p) - np.log(1 - p)))
        out.append((f, cut, left, right, weight))
    return out


@pytest.mark.parametrize("algorithm", ["SAMME", "SAMME.R"])
@pytest.mark.parametrize("values", [1 << 22, 300])
def test_stumps_equal_an_independent_search(spark, monkeypatch, algorithm, values):
    """On an imbalanced table, where both sides of a cut often say 0; in one block and in several."""
    monkeypatch.setattr(binned, "BLOCK_VALUES", values)
    x, y = table()
    got = AdaBoost(rounds=4, algorithm=algorithm).fit(frame(spark, x, y)).stumps
    want = plain_stumps(x, y, 4, algorithm)
    assert len(got) == len(want) and all(s.feature is not None for s in got)
    for s, (f, cut, left, right, weight) in zip(got, want):
        assert (s.feature, s.threshold) == (f, pytest.approx(cut))
        assert (s.left, s.right, s.weight) == (pytest.approx(left), pytest.approx(right), pytest.approx(weight))


def plain_trees(x, y, rounds, step, depth):
    """Second-order boosting by trying every middle between two values."""
    score, out = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        value = np.zeros(len(y))

        def grow(rows, left):
            G, H = g[rows].sum(), h[rows].sum()
            value[rows] = -step * G / (H + 1)
            if not left:
                return
            best = (1e-12, None)
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    a = rows & (x[:, f] <= cut)
                    ga, ha = g[a].sum(), h[a].sum()
                    if ha < 1 or H - ha < 1:
                        continue
                    gain = ga**2 / (ha + 1) + (G - ga) ** 2 / (H - ha + 1) - G**2 / (H + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, a)
            if best[1] is not None:
                grow(best[1], left - 1)
                grow(rows & ~best[1], left - 1)

        grow(np.ones(len(y), bool), depth)
        score = score + value
        out.append(score)
    return 1 / (1 + np.exp(-out[-1]))


@pytest.mark.parametrize("values", [1 << 22, 300])
def test_boosted_trees_equal_a_plain_version(spark, monkeypatch, values):
    monkeypatch.setattr(binned, "BLOCK_VALUES", values)
    monkeypatch.setattr(boosted, "WRITE_EVERY", 3)
    x, y = table(n=300, d=3)
    df = frame(spark, x, y)
    model = models.boosted_trees(maxIter=8, stepSize=0.3, maxDepth=2).fit(df)
    got = [r.score for r in models.score_rows(model, df, ["i"]).orderBy("i").collect()]
    assert got == pytest.approx(plain_trees(x, y, 8, 0.3, 2).tolist(), abs=1e-9)
    assert model.featureImportances.sum() == pytest.approx(1.0)


def test_quantile_cuts_keep_wide_features(spark):
    """More values than bins: cuts are quantiles, equal rows collapse, counts add up."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=2000), rng.integers(0, 2, 2000)])
    held = binned.bin_rows(frame(spark, x, x[:, 0] > 1), max_bins=16)
    assert len(held.cuts[0]) == 15 and held.cuts[1].tolist() == [0.5] and held.rows == 2000
    block = held.blocks.collect()[0]
    assert block.count.sum() == 2000 and len(block.count) <= 16 * 2 * 2
    shares = np.bincount(block.keys[:, 0], weights=block.count) / 2000
    assert abs(shares - 1 / 16).max() < 0.02
    held.release()


def test_no_rows(spark):
    df = frame(spark, [[1.0, 2.0]], [1]).where("i < 0")
    assert AdaBoost(rounds=3).fit(df).stumps == []
    assert models.boosted_trees(maxIter=3).fit(df).trees == []


@pytest.fixture(scope="module")
def folded(spark):
    x, y = table(seed=5, n=320)
    return expanding_folds(frame(spark, x, y), ["i"], 3).cache()


def test_staged_boosting_equals_single_fits(spark, folded):
    """Scores of all numbers of rounds from one fit are those of fits of their own."""
    grid = {"algorithm": ["SAMME", "SAMME.R"], "rounds": [1, 3, 8]}
    for r in models.grid_scores(folded, AdaBoost, grid).collect():
        model = AdaBoost(rounds=int(r.rounds), algorithm=r.algorithm).fit(fold_train(folded, r.fold))
        assert r.score == pytest.approx(models.model_metrics(model, fold_test(folded, r.fold))["recall_macro"])


def test_folds_share_a_binning(spark, folded):
    for k, model in enumerate(AdaBoost(rounds=3).fit_folds(folded, 3)):
        alone = AdaBoost(rounds=3).fit(fold_train(folded, k))
        assert [(s.feature, pytest.approx(s.left)) for s in alone.stumps] == [(s.feature, s.left) for s in model.stumps]
    scores = models.fold_scores(folded, {"b": lambda: models.boosted_trees(maxIter=3), "f": lambda: models.forest(numTrees=2, maxDepth=2)}, 3)
    assert scores.groupBy("model", "fold").count().count() == 6


def test_prefixes_and_tops_of_a_forest(spark, folded):
    """Counts of the first trees cut at a depth equal an average over Spark's own trees."""
    train, test = fold_train(folded, 2), fold_test(folded, 2)
    model = models.forest(numTrees=6, maxDepth=5).fit(train)
    cells = forests.prefix_cells(model, test, [1, 4, 6], [0, 2, 5])
    rows = test.select(vector_to_array("features").alias("x"), "label").collect()
    x, label = np.array([r.x for r in rows]), np.array([int(r.label) for r in rows])
    mean = sum(model.nodes.shares(x, slice(k, k + 1), [30])[0, 0] for k in range(4)) / 4
    want = np.bincount(2 * label + (mean > 0.5), minlength=4).reshape(2, 2)
    assert (cells[1, 2] == want).all() and (cells.sum(axis=(2, 3)) == len(rows)).all()
    # At depth 0 every row has its tree's mean.
    assert (cells[:, 0].sum(axis=1) > 0).sum(axis=1).tolist() == [1, 1, 1]
    shallow = models.grid_scores(folded, models.forest, {"maxDepth": [1, 30], "numTrees": [1, 3]}).collect()
    assert len(shallow) == 12 and all(0 <= r.score <= 1 for r in shallow)


def walk(nodes, root, values):
    at = root
    while nodes.feature[at] >= 0:
        at = nodes.left[at] if values[nodes.feature[at]] <= nodes.threshold[at] else nodes.right[at]
    return nodes.share[at]


@pytest.mark.parametrize("values", [1 << 22, 300])
def test_leaves_hold_their_rows_share(spark, monkeypatch, values):
    """An unsampled tree on all features: every leaf's share is that of its rows; in tasks and by Spark ML."""
    monkeypatch.setattr(binned, "BLOCK_VALUES", values)
    x, y = table(n=300, d=3)
    df = frame(spark, x, y)
    model = models.forest(numTrees=2, maxDepth=4, bootstrap=False, featureSubsetStrategy="all").fit(df)
    nodes = model.nodes
    got = np.array([walk(nodes, nodes.root[0], v) for v in x])
    for share in np.unique(got):
        assert share == pytest.approx(y[got == share].mean())
    scored = [r.score for r in models.score_rows(model, df, ["i"]).orderBy("i").collect()]
    want = [(walk(nodes, nodes.root[0], v) + walk(nodes, nodes.root[1], v)) / 2 for v in x]
    assert scored == pytest.approx(want)
    assert np.sum(model.featureImportances) == pytest.approx(1.0)


def test_random_cuts_are_the_drawn_ones(spark):
    x, y = table(seed=9, n=500)
    df = frame(spark, x, y)
    learner = models.unsampled_forest(num_trees=4)
    model, again = learner.fit(df), learner.fit(df)
    assert (model.featureImportances == again.featureImportances).all()
    assert not np.allclose(model.featureImportances, models.forest(numTrees=4, bootstrap=False).fit(df).featureImportances)
    low, high = x.min(axis=0), x.max(axis=0)
    for tree, (one, drawn) in enumerate(zip(model.trees, model.drawn)):
        assert drawn == learner.draw(low, high, tree) and all(a <= c <= b for f, (a, b) in enumerate(zip(low, high)) for c in drawn[f])
        nodes = forests.Nodes.of(spark, one)
        inner = nodes.feature >= 0
        # Trees cut between bins, and bins are counts of drawn thresholds.
        assert inner.any() and all(0 <= t < len(drawn[f]) for f, t in zip(nodes.feature[inner], nodes.threshold[inner]))
    got = models.score_rows(model, df, ["i"]).orderBy("i").collect()
    assert all(0 <= r.score <= 1 for r in got) and np.mean([(r.score > 0.5) == (r.label == 1) for r in got]) > 0.9

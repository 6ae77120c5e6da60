"""Models on small vectors; AdaBoost is replayed in numpy round by round."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import models
from riskpanel.operators.adaboost import AdaBoost, Stump
from riskpanel.plans import evaluation

NAMES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        a, b = rng.random(), rng.random()
        label = int(a + 0.5 * b + 0.3 * rng.random() > 0.9)
        rows.append((dt.date(2010 + i // 60, 12, 31), i, a, b, rng.random(), label))
    df = spark.createDataFrame(rows, "period date, area int, a double, b double, noise double, target int")
    return evaluation.hold(
        evaluation.prepare_dataset(df, NAMES, ["area"], "2013-12-31", "2012-12-31")
    )


def matrix(df):
    rows = df.orderBy("period", "area").collect()
    return np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows])


def test_temporal_split_modes(spark):
    df = spark.createDataFrame([(dt.date(y, 12, 31),) for y in range(2010, 2015)], "p date")
    within = models.temporal_split(df, "p", "2013-12-31", "2012-12-31")
    assert [within[k].count() for k in ("train", "validation", "test")] == [4, 3, 1]
    holdout = models.temporal_split(df, "p", "2013-12-31", "2012-12-31", "holdout")
    assert [holdout[k].count() for k in ("train", "validation", "test")] == [3, 1, 1]
    with pytest.raises(ValueError):
        models.temporal_split(df, "p", "2013-12-31", "2012-12-31", "other")


@pytest.mark.parametrize("algorithm,every", [("SAMME.R", 100), ("SAMME.R", 2), ("SAMME", 100)])
def test_adaboost_replay(data, algorithm, every):
    model = AdaBoost(rounds=5, algorithm=algorithm, checkpoint_every=every).fit(data.train)
    x, y = matrix(data.train)
    w = np.ones(len(y))
    for stump in model.stumps:
        left = x[:, stump.feature] <= stump.threshold
        for side, chance in ((left, stump.left), (~left, stump.right)):
            assert chance == pytest.approx((w * y)[side].sum() / w[side].sum(), rel=1e-6)
        p = np.where(left, stump.left, stump.right)
        miss = (p > 0.5) != (y == 1)
        if algorithm == "SAMME":
            error = (w * miss).sum() / w.sum()
            assert stump.weight == pytest.approx(np.log(1 / error - 1), rel=1e-6)
            w = w * np.exp(stump.weight * miss)
        else:
            odds = np.log(np.clip(p, 2.2e-16, None)) - np.log(np.clip(1 - p, 2.2e-16, None))
            w = w * np.exp(-0.5 * (2 * y - 1) * odds)
    xt, _ = matrix(data.test)
    total = np.zeros(len(xt))
    for stump in model.stumps:
        p = np.where(xt[:, stump.feature] <= stump.threshold, stump.left, stump.right)
        total += stump.weight * np.where(p > 0.5, 1, -1) if algorithm == "SAMME" else np.log(p) - np.log(1 - p)
    got = model.transform(data.test).orderBy("period", "area").collect()
    assert [r["prediction"] for r in got] == [float(v > 0) for v in total]
    assert all(0 < r["probability"] < 1 for r in got)


def test_adaboost_stops_on_a_perfect_stump(spark):
    df = models.assemble(
        spark.createDataFrame([(float(i), int(i > 4)) for i in range(10)], "v double, t int"), ["v"], "t"
    )
    model = AdaBoost(rounds=20).fit(df)
    assert len(model.stumps) == 1
    done = model.transform(df).collect()
    assert all(r["prediction"] == r["label"] for r in done)
    assert Stump.vote(0.5) == -1.0


def test_reports_and_importances(data):
    learners = {"forest": lambda: models.forest(numTrees=10, maxDepth=4), "ada": lambda: AdaBoost(rounds=3)}
    rows = {r["model"]: r for r in evaluation.compare_models(data, learners).collect()}
    assert set(rows) == {"forest", "ada"}
    for r in rows.values():
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == 60
        assert r["accuracy"] > 0.7
        assert r["auc"] == pytest.approx(r["recall_macro"])
    ranked = evaluation.ranked_features(data, lambda: models.unsampled_forest(depth=3), k=2).collect()
    assert [r["feature"] for r in ranked][0] == "a" and len(ranked) == 2


def test_sweep_thresholds_skip_rules():
    values = [("a", 0.0), ("b", 0.0), ("c", 0.1), ("d", 0.1), ("e", 0.2), ("f", 0.3), ("g", 0.4)]
    assert models.sweep_thresholds(values) == [("c", 0.1), ("e", 0.2)]
    assert models.features_at_least(values, 0.2) == ["e", "f", "g"]
    assert models.sweep_thresholds([]) == []


def test_selection_and_search(data):
    sweep, importances = evaluation.selection_sweep(
        data, lambda: models.forest(numTrees=5, maxDepth=4), lambda: models.forest(numTrees=3, maxDepth=2)
    )
    assert sweep.count() <= 1
    threshold = importances[1][1]
    cut = evaluation.selected(data, importances, threshold)
    assert len(cut.names) == 2
    first = cut.train.orderBy("period", "area").first()
    full = data.train.orderBy("period", "area").first()
    assert list(first["features"].toArray()) == [full["features"][NAMES.index(n)] for n in cut.names]
    grid = {"maxDepth": [1, 4], "numTrees": [3]}
    summary, best = evaluation.search(cut, models.forest, grid)
    rows = {r["combo"]: r for r in summary.collect()}
    assert len(rows) == 2 and all(r["folds"] == 3 for r in rows.values())
    top = max(rows.values(), key=lambda r: (r["mean_score"], -r["combo"]))
    assert best == models.parameter_grid(grid)[top["combo"]]
    report = {r["class"]: r["support"] for r in evaluation.search_report(cut, models.forest, best).collect()}
    assert report["weighted"] == report["0"] + report["1"] == 60


def test_tuned_model_and_bands(data):
    scores = evaluation.tuned_scores(data, {"numTrees": 5})
    levels = evaluation.risk_levels(scores).collect()
    assert sum(r["n"] for r in levels) == 60
    band, areas = evaluation.curve_bands(data, {"f": lambda: models.forest(numTrees=3, maxDepth=3)}, n_splits=3)
    assert band.count() == 100
    assert 0.5 < areas.first()["mean_auc"] <= 1


def test_null_feature_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 0)], "v double, t int")
    with pytest.raises(Exception):
        models.assemble(df, ["v"], "t").collect()


def test_carry_forward_fills_from_the_last_period(spark):
    df = spark.createDataFrame(
        [(dt.date(2010, 12, 31), 1, 5.0, 1), (dt.date(2011, 12, 31), 1, None, 0)],
        "period date, area int, v double, target int",
    )
    made = evaluation.prepare_dataset(df, ["v"], ["area"], "2012-12-31", "2011-12-31", carry_forward=True)
    assert [r["features"][0] for r in made.train.collect()] == [5.0, 5.0]
    assert made.train.where(F.col("label").isNull()).count() == 0


def test_whole_evaluation(spark, data, tmp_path):
    from riskpanel.plans import workflow

    small = lambda: models.forest(numTrees=3, maxDepth=3)
    settings = workflow.Settings(
        learners={"forest": small, "adaboost": lambda: AdaBoost(rounds=2)},
        ranker=small,
        sweep_learner=small,
        forest_grid={"maxDepth": [2, 3], "numTrees": [2]},
        adaboost_grid={"rounds": [1, 2]},
        tuned={"numTrees": 4, "maxDepth": 3},
        importance_learner=lambda: models.unsampled_forest(num_trees=2, depth=3),
        curve_learners={"forest": small},
        curve_folds=2,
    )
    written = workflow.evaluate(data, str(tmp_path), "r1", settings)
    assert spark.read.parquet(written["roc_band"]).count() == 100
    assert spark.read.parquet(written["forest_search"]).count() == 2
    assert spark.read.parquet(written["final_scores"]).count() == 60
    reports = spark.read.parquet(written["model_reports"])
    assert {r["model"] for r in reports.collect()} == {"forest", "adaboost"}
    assert "adaboost_search_report" in written and "importances" in written


def test_catalog_uses_published_settings(monkeypatch):
    from riskpanel.plans.catalog import models as catalog

    monkeypatch.setattr(catalog, "dataset", lambda t: None)
    monkeypatch.setattr(catalog, "_report", lambda t, name, learner: learner)
    monkeypatch.setattr(evaluation, "search", lambda data, learner, grid: (grid, grid))
    monkeypatch.setattr(evaluation, "search_report", lambda data, learner, best: best)
    monkeypatch.setattr(evaluation, "ranked_features", lambda data, learner: learner())
    monkeypatch.setattr(evaluation, "selection_sweep", lambda data, ranker, learner: ((ranker(), learner()), None))
    monkeypatch.setattr(evaluation, "tuned_scores", lambda data, params=None: params or {})
    monkeypatch.setattr(evaluation, "risk_levels", lambda scores: scores)
    monkeypatch.setattr(evaluation, "curve_bands", lambda data, learners: ({k: make() for k, make in learners.items()}, None))
    monkeypatch.setattr(models, "forest", lambda **params: {**models.FOREST, **params})
    monkeypatch.setattr(models, "boosted_trees", lambda **params: {**models.BOOSTED_TREES, **params})
    monkeypatch.setattr(models, "unsampled_forest", lambda **params: params)
    assert catalog.rf_report(None) == catalog.feature_importance_topk(None) == models.FOREST
    assert catalog.gbt_report(None) == models.BOOSTED_TREES and catalog.extra_importance(None) == {}
    assert catalog.adaboost_report(None).rounds == catalog.adaboost_samme_report(None).rounds == 100
    assert catalog.adaboost_samme_report(None).algorithm == "SAMME"
    assert catalog.threshold_sweep(None) == (models.FOREST, {**models.FOREST, **models.SWEEP_FOREST})
    assert catalog.grid_search_rf(None) == catalog.search_report(None) == models.FOREST_GRID
    assert catalog.grid_search_ada(None) == models.ADABOOST_GRID and catalog.tuned_model_risk(None) == {}
    bands = catalog.model_roc_band(None)
    assert bands["forest"] == models.TUNED_FOREST and bands["boosted_trees"]["maxIter"] == 1500 and bands["adaboost"].rounds == 100

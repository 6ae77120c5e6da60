"""Curves and metrics against plain Python."""

import random

import numpy as np
import pytest

from riskpanel.operators import curves, metrics


def brute_curve(rows):
    """All (fp, tp) points by descending score, starting at (0, 0)."""
    points, fp, tp = [(0, 0)], 0, 0
    for score in sorted({s for s, _ in rows}, reverse=True):
        tp += sum(1 for s, y in rows if s == score and y == 1)
        fp += sum(1 for s, y in rows if s == score and y == 0)
        points.append((fp, tp))
    return points


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    data = [(m, rng.randrange(3), rng.randrange(40) / 40, rng.randrange(2)) for m in "ab" for _ in range(200)]
    return data, spark.createDataFrame(data, "model string, fold int, score double, label int").cache()


def groups(data):
    found = {}
    for model, fold, score, label in data:
        found.setdefault((model, fold), []).append((score, label))
    return found


@pytest.mark.parametrize("limit", [0, 10**6])
def test_auc_and_grid(scored, limit):
    data, df = scored
    steps = curves.roc_steps(df, "score", "label", ["model", "fold"], limit).cache()
    areas = {(r["model"], r["fold"]): r["auc"] for r in curves.auc_from_steps(steps, ["model", "fold"]).collect()}
    grid = {}
    for r in curves.roc_on_grid(steps, ["model", "fold"]).collect():
        grid[r["model"], r["fold"], r["grid"]] = r["tpr"]
    for key, rows in groups(data).items():
        points = np.array(brute_curve(rows), dtype=float)
        x, y = points[:, 0] / points[-1, 0], points[:, 1] / points[-1, 1]
        assert areas[key] == pytest.approx(np.trapezoid(y, x))
        # Slightly to the right of each grid point the upper of several values counts.
        expected = np.interp(np.linspace(0, 1, 100) + 1e-12, x + np.arange(len(x)) * 1e-15, y)
        expected[0] = 0.0
        got = np.array([grid[(*key, j)] for j in range(100)])
        assert np.allclose(got, expected, atol=1e-6)


def test_band(scored):
    _, df = scored
    band, areas = curves.roc_band(df, "score", "label")
    rows = band.orderBy("model", "grid").collect()
    assert len(rows) == 200
    assert all(0 <= r["lower"] <= r["mean_tpr"] <= r["upper"] <= 1 for r in rows)
    assert {r["folds"] for r in areas.collect()} == {3}


def test_collinear_points_are_dropped_but_area_stays(spark):
    df = spark.createDataFrame([(s / 10, y) for s in range(5) for y in (0, 1)], "score double, label int")
    kept = curves.roc_curve(df, "score", "label").collect()
    assert sorted((r["fp"], r["tp"]) for r in kept) == [(0, 0), (1, 1), (5, 5)]
    full = curves.roc_curve(df, "score", "label", drop_collinear=False)
    assert full.count() == 6
    assert curves.auc(df, "score", "label").first()[0] == 0.5


def test_one_class_has_no_curve(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert curves.auc(df, "score", "label").first()[0] is None


CELLS = [
    ((50, 10, 20, 20), (0.70, 2 / 3, 0.5, 0.3478, 2 / 3)),
    ((5, 0, 1, 4), (0.90, 1.0, 0.8, 0.8, 0.9)),
]


@pytest.mark.parametrize("cells,expected", CELLS)
def test_metrics_by_hand(spark, cells, expected):
    tn, fp, fn, tp = cells
    data = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    df = spark.createDataFrame(data, "label int, prediction int")
    m = metrics.classification_metrics(metrics.confusion_cells(df)).first()
    got = (m["accuracy"], m["precision"], m["recall"], m["kappa"], m["auc"])
    assert got == pytest.approx(expected, abs=1e-4)
    assert curves.auc(df, "prediction", "label").first()[0] == pytest.approx(m["auc"])
    assert m["recall_macro"] == pytest.approx(m["auc"])


def test_empty_cells_stay_in_the_matrix(spark):
    df = spark.createDataFrame([(1, 0)], "label int, prediction int")
    cells = metrics.confusion_cells(df)
    assert sorted(tuple(r) for r in metrics.confusion_matrix(cells).collect()) == [
        (0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 0)
    ]
    m = metrics.classification_metrics(cells).first()
    assert m["precision"] is None and m["recall"] == 0.0 and m["f1"] is None


def test_risk_histogram(spark):
    df = spark.createDataFrame([(0.3,), (0.7,), (1.0,), (0.29999,)], "score double")
    assert [r["n"] for r in metrics.risk_histogram(df, "score").orderBy("bin").collect()] == [1, 1, 2]


def test_report_weights(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(1, 0), (1, 1)], "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(metrics.confusion_cells(df)).collect()}
    assert report["0"]["precision"] == pytest.approx(0.75)
    assert report["1"]["recall"] == pytest.approx(0.5)
    assert report["weighted"]["recall"] == pytest.approx(0.8)
    assert report["weighted"]["support"] == 5
    assert metrics.score_summary(
        spark.createDataFrame([(1, 0.2), (1, 0.4)], "p int, score double"), ["p"]
    ).first()["two_std"] == pytest.approx(0.2)

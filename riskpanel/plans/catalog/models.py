"""Model queries on a monthly panel of the test tables.

The panel is written once per session as the training matrix that all model
queries read. Ensembles, grids and sweeps are the library's defaults, which are
the published settings; every query fits on all rows.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ...operators import models
from ...operators.adaboost import AdaBoost
from ...sources import sinks
from .. import evaluation
from .base import AREA, Tables, query, scratch_folder
from .panels import order_panel

TRAIN_UNTIL = "1999-12-31"
VALIDATION_UNTIL = "1998-12-31"

_written: dict[tuple[str, str], tuple[str, list[str]]] = {}
_held: dict[tuple[str, str], evaluation.Dataset] = {}


def _session_key(t: Tables) -> tuple[str, str]:
    return (t.spark.sparkContext.applicationId, t.folder)


def training_table(t: Tables):
    """The monthly panel as a written table, and its feature names."""
    key = _session_key(t)
    if key not in _written:
        result = order_panel(t, "month", min_ratio=0.0001)
        folder = sinks.write_training_matrix(result.panel, scratch_folder(t.spark, "training-matrix"))
        _written[key] = (folder, result.features)
    folder, features = _written[key]
    return t.spark.read.parquet(folder), features


def dataset(t: Tables) -> evaluation.Dataset:
    """Assembled vectors, kept for all model queries of the session."""
    key = _session_key(t)
    if key not in _held:
        panel, features = training_table(t)
        _held[key] = evaluation.hold(
            evaluation.prepare_dataset(panel, features, AREA, TRAIN_UNTIL, VALIDATION_UNTIL)
        )
    return _held[key]


def _report(t: Tables, name: str, learner):
    data = dataset(t)
    model = learner.fit(data.train)
    return models.model_report(name, model, data.test)


@query(
    "training_matrix",
    """WITH placed AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, c_nationkey, c_mktsegment, o_orderpriority
                    FROM orders JOIN customer ON o_custkey = c_custkey),
            areas AS (SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)),
            months AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(month)), max(month), INTERVAL 1 MONTH)) AS DATE) AS m
                       FROM placed),
            hit AS (SELECT DISTINCT month, c_nationkey, c_mktsegment FROM placed WHERE o_orderpriority LIKE '1%')
       SELECT CAST(year(m) AS INTEGER) AS year, CAST(count(*) * (SELECT n FROM areas) AS BIGINT) AS rows,
              CAST(sum((SELECT count(*) FROM hit WHERE month = last_day(m))) AS BIGINT) AS targets
       FROM months GROUP BY 1""",
)
def training_matrix(t: Tables):
    """Rows and targets of the written panel per year."""
    panel, _ = training_table(t)
    return panel.groupBy(F.year("period").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("target").alias("targets")
    )


@query("rf_report")
def rf_report(t: Tables):
    return _report(t, "forest", models.forest())


@query("gbt_report")
def gbt_report(t: Tables):
    return _report(t, "boosted_trees", models.boosted_trees())


@query("adaboost_report")
def adaboost_report(t: Tables):
    return _report(t, "adaboost", AdaBoost(**models.ADABOOST, seed=models.SEED))


@query("adaboost_samme_report")
def adaboost_samme_report(t: Tables):
    return _report(t, "adaboost_samme", AdaBoost(**{**models.ADABOOST, "algorithm": "SAMME"}, seed=models.SEED))


@query("feature_importance_topk")
def feature_importance_topk(t: Tables):
    return evaluation.ranked_features(dataset(t), models.forest)


@query("extra_importance")
def extra_importance(t: Tables):
    return evaluation.ranked_features(dataset(t), models.unsampled_forest)


def _sweep(t: Tables):
    return evaluation.selection_sweep(dataset(t), models.forest, lambda: models.forest(**models.SWEEP_FOREST))[0]


@query("threshold_sweep")
def threshold_sweep(t: Tables):
    return _sweep(t)


@query("best_threshold")
def best_threshold(t: Tables):
    return evaluation.best_threshold(_sweep(t))


@query("grid_search_rf")
def grid_search_rf(t: Tables):
    return evaluation.search(dataset(t), models.forest, models.FOREST_GRID)[0]


@query("grid_search_ada")
def grid_search_ada(t: Tables):
    return evaluation.search(dataset(t), AdaBoost, models.ADABOOST_GRID)[0]


@query("search_report")
def search_report(t: Tables):
    """Per class report of the refitted best combination."""
    data = dataset(t)
    _, best = evaluation.search(data, models.forest, models.FOREST_GRID)
    return evaluation.search_report(data, models.forest, best)


@query("tuned_model_risk")
def tuned_model_risk(t: Tables):
    return evaluation.risk_levels(evaluation.tuned_scores(dataset(t)))


@query("model_roc_band")
def model_roc_band(t: Tables):
    """ROC bands of three learners over seven expanding folds."""
    return evaluation.curve_bands(dataset(t), {**evaluation.default_learners(), "forest": lambda: models.forest(**models.TUNED_FOREST)})[0]


def _round_sql(number: int, rows: str) -> str:
    """One boosting round over rows (f0, f1, f2, y, w): the cut with the smallest impurity and its sides."""
    sides = " UNION ALL ".join(f"SELECT {k} AS feature, f{k} AS side, y, w FROM {rows}" for k in range(3))
    return f"""
 g{number} AS (SELECT feature, sum(w) FILTER (side = 0) AS n0, coalesce(sum(w) FILTER (side = 0 AND y = 1), 0) AS p0,
               sum(w) FILTER (side = 1) AS n1, coalesce(sum(w) FILTER (side = 1 AND y = 1), 0) AS p1 FROM ({sides}) GROUP BY 1),
 b{number} AS (SELECT feature, p0 / n0 AS l, p1 / n1 AS r FROM g{number} ORDER BY p0 * (n0 - p0) / n0 + p1 * (n1 - p1) / n1, feature LIMIT 1)"""


_BOOST_ROWS_SQL = """
 rows1 AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS f0, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f1,
           CASE WHEN month(o_orderdate) < 6 THEN 1 ELSE 0 END AS f2,
           CASE WHEN o_totalprice + (CASE WHEN o_orderstatus = 'F' THEN 60000 ELSE 0 END)
                  - (CASE WHEN o_orderpriority LIKE '1%' THEN 30000 ELSE 0 END) > 250000 THEN 1 ELSE 0 END AS y, 1.0::DOUBLE AS w
    FROM orders)"""
_NEXT_ROWS_SQL = """
 rows2 AS (SELECT f0, f1, f2, y, w * exp((CASE WHEN y = 1 THEN -0.5 ELSE 0.5 END) * ln(p / (1 - p))) AS w
           FROM (SELECT *, CASE WHEN CASE feature WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END = 0 THEN l ELSE r END AS p FROM rows1, b1))"""


@query(
    "adaboost_rounds",
    f"""WITH {_BOOST_ROWS_SQL}, {_round_sql(1, "rows1")}, {_NEXT_ROWS_SQL}, {_round_sql(2, "rows2")}
       SELECT CAST(1 AS INTEGER) AS round, feature, round(l, 6) AS left_share, round(r, 6) AS right_share FROM b1
       UNION ALL SELECT 2, feature, round(l, 6), round(r, 6) FROM b2""",
)
def adaboost_rounds(t: Tables):
    """The first two stumps of SAMME.R on three 0/1 features: cut and share of class 1 per side."""
    first = F.col("o_orderpriority").startswith("1")
    done = F.col("o_orderstatus") == "F"
    label = F.col("o_totalprice") + F.when(done, 60000).otherwise(0) - F.when(first, 30000).otherwise(0) > 250000
    flags = [c.cast("double") for c in (first, done, F.month("o_orderdate") < 6)]
    rows = t.orders.select(array_to_vector(F.array(*flags)).alias("features"), label.cast("double").alias("label"))
    stumps = AdaBoost(rounds=2, algorithm="SAMME.R").fit(rows).stumps
    found = [(k + 1, s.feature, round(s.left, 6), round(s.right, 6)) for k, s in enumerate(stumps)]
    return t.spark.createDataFrame(found, "round int, feature int, left_share double, right_share double")

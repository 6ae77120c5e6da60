"""Metrics on deterministic scores and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import curves, metrics, models
from .base import Tables, big, query, rounded


def predicted_lines(t: Tables):
    """A rule that predicts returns from the quantity and the discount, per line status."""
    return t.lineitem.select(
        F.col("l_linestatus").alias("model"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when((F.col("l_quantity") > 30) & (F.col("l_discount") < 0.07), 1).otherwise(0).alias("prediction"),
    )


_CELLS_SQL = """
 predicted AS (SELECT l_linestatus AS model, l_returnflag = 'R' AS label,
                      l_quantity > 30 AND l_discount < 0.07 AS prediction FROM lineitem),
 cells AS (SELECT model, count(*) FILTER (NOT label AND NOT prediction) AS tn, count(*) FILTER (NOT label AND prediction) AS fp,
                  count(*) FILTER (label AND NOT prediction) AS fn, count(*) FILTER (label AND prediction) AS tp
           FROM predicted GROUP BY model),
 rates AS (SELECT *, tn + fp + fn + tp AS n, (tn + tp) / (tn + fp + fn + tp) AS po,
                  ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tn + fp + fn + tp) * (tn + fp + fn + tp)) AS pe,
                  tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, tp / (tp + fp) AS prec FROM cells)"""


def _cells(t: Tables):
    return metrics.confusion_cells(predicted_lines(t), groups=["model"])


@query(
    "confusion_cells",
    f"""WITH {_CELLS_SQL} SELECT model, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
        CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM cells""",
)
def confusion_cells(t: Tables):
    return _cells(t)


@query(
    "confusion_matrix",
    f"""WITH {_CELLS_SQL}
       SELECT model, 0 AS actual, 0 AS predicted, CAST(tn AS BIGINT) AS n FROM cells
       UNION ALL SELECT model, 0, 1, fp FROM cells UNION ALL SELECT model, 1, 0, fn FROM cells
       UNION ALL SELECT model, 1, 1, tp FROM cells""",
)
def confusion_matrix(t: Tables):
    return metrics.confusion_matrix(_cells(t), ["model"])


_METRICS_SQL = """round(po, 9) AS accuracy, round((po - pe) / (1 - pe), 9) AS kappa,
   round((recall + specificity) / 2, 9) AS auc, round(recall, 9) AS recall, round(prec, 9) AS precision,
   round(2 * prec * recall / (prec + recall), 9) AS f1, round((recall + specificity) / 2, 9) AS recall_macro"""


@query("classification_metrics", f"WITH {_CELLS_SQL} SELECT model, {_METRICS_SQL} FROM rates")
def classification_metrics(t: Tables):
    found = metrics.classification_metrics(_cells(t), ["model"])
    return found.select("model", *[rounded(c, 9).alias(c) for c in found.columns if c != "model"])


@query(
    "metric_rows",
    f"""WITH {_CELLS_SQL}, wide AS (SELECT model, {_METRICS_SQL} FROM rates)
       SELECT model, metric, value FROM wide
       UNPIVOT (value FOR metric IN (accuracy, kappa, auc, recall, precision, f1, recall_macro))""",
)
def metric_rows(t: Tables):
    """Report as (model, metric, value) rows."""
    return metrics.long_report(classification_metrics(t), ["model"])


@query(
    "classification_report",
    f"""WITH {_CELLS_SQL}, classes AS (
         SELECT model, '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS support FROM cells
         UNION ALL SELECT model, '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM cells),
       scored AS (SELECT *, 2 * p * r / (p + r) AS f FROM classes)
       SELECT model, class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1,
              CAST(support AS BIGINT) AS support FROM scored
       UNION ALL SELECT model, 'weighted', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9),
              round(sum(f * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM scored GROUP BY model""",
)
def classification_report(t: Tables):
    found = metrics.classification_report(_cells(t), ["model"])
    return found.select(
        "model", "class", *[rounded(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query(
    "risk_histogram",
    """WITH scores AS (SELECT l_linestatus AS model, l_discount * 10 AS score FROM lineitem),
            bins AS (SELECT model, CASE WHEN score < 0.3 THEN 0 WHEN score < 0.7 THEN 1 ELSE 2 END AS bin
                     FROM scores WHERE score >= 0 AND score <= 1)
       SELECT model, bin, CAST([0.0, 0.3, 0.7][bin + 1] AS DOUBLE) AS low, CAST([0.3, 0.7, 1.0][bin + 1] AS DOUBLE) AS high,
              CAST(count(*) AS BIGINT) AS n,
              count(*) / sum(count(*)) OVER (PARTITION BY model) AS share
       FROM bins GROUP BY model, bin""",
)
def risk_histogram(t: Tables):
    lines = t.lineitem.select(F.col("l_linestatus").alias("model"), (F.col("l_discount") * 10).alias("score"))
    return metrics.risk_histogram(lines, "score", groups=["model"])


@query(
    "grid_score_summary",
    """WITH scores AS (SELECT p_brand AS params, p_size % 3 AS fold,
                              sum(CASE WHEN p_type LIKE 'S%' THEN 1.0 ELSE 0.0 END) / count(*) AS score
                       FROM part GROUP BY ALL)
       SELECT params, round(avg(score), 9) AS mean_score, round(2 * stddev_pop(score), 9) AS two_std,
              CAST(count(*) AS BIGINT) AS folds FROM scores GROUP BY 1""",
)
def grid_score_summary(t: Tables):
    scores = t.part.groupBy(F.col("p_brand").alias("params"), F.expr("p_size % 3").alias("fold")).agg(
        F.avg(F.when(F.col("p_type").startswith("S"), 1.0).otherwise(0.0)).alias("score")
    )
    found = metrics.score_summary(scores, ["params"])
    return found.withColumns({"mean_score": rounded("mean_score", 9), "two_std": rounded("two_std", 9)})


@query(
    "temporal_split",
    """WITH days AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders),
            parts AS (
              SELECT 'within' AS mode, 'train' AS part, d FROM days WHERE d <= DATE '1999-12-31'
              UNION ALL SELECT 'within', 'validation', d FROM days WHERE d <= DATE '1998-12-31'
              UNION ALL SELECT 'within', 'test', d FROM days WHERE d > DATE '1999-12-31'
              UNION ALL SELECT 'holdout', 'train', d FROM days WHERE d <= DATE '1998-12-31'
              UNION ALL SELECT 'holdout', 'validation', d FROM days WHERE d > DATE '1998-12-31' AND d <= DATE '1999-12-31'
              UNION ALL SELECT 'holdout', 'test', d FROM days WHERE d > DATE '1999-12-31')
       SELECT mode, part, CAST(count(*) AS BIGINT) AS rows, min(d) AS first_day, max(d) AS last_day FROM parts GROUP BY ALL""",
)
def temporal_split(t: Tables):
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("d"))
    counted = []
    for mode in ("within", "holdout"):
        for part, rows in models.temporal_split(days, "d", "1999-12-31", "1998-12-31", mode).items():
            counted.append(
                rows.agg(
                    big(F.count(F.lit(1))).alias("rows"), F.min("d").alias("first_day"), F.max("d").alias("last_day")
                ).select(F.lit(mode).alias("mode"), F.lit(part).alias("part"), "rows", "first_day", "last_day")
            )
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


@query(
    "hard_label_auc",
    f"WITH {_CELLS_SQL} SELECT model, round((recall + specificity) / 2, 9) AS auc FROM rates",
)
def hard_label_auc(t: Tables):
    """Area of the curve whose score is the hard prediction."""
    from ...operators.curves import auc

    return auc(predicted_lines(t), "prediction", "label", ["model"]).withColumn("auc", rounded("auc", 9))


@query(
    "auc_bucketed",
    """WITH scored AS (SELECT o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS score, o_orderpriority LIKE '1%' AS label FROM orders),
            edges AS (SELECT min(score) AS low, max(score) AS high FROM scored),
            counts AS (SELECT status, greatest(least(floor((score - edges.low) / (edges.high - edges.low) * 4096), 4095), 0) AS bucket,
                              count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg, min(score) AS low, max(score) AS high
                       FROM scored, edges GROUP BY 1, 2),
            steps AS (SELECT *, sum(pos) OVER (PARTITION BY status ORDER BY bucket DESC) AS tp FROM counts)
       SELECT status, round(sum(neg * (2 * tp - pos))::DOUBLE / (2.0::DOUBLE * sum(pos) * sum(neg)), 9) AS auc,
              round(coalesce(sum(pos * neg) FILTER (low < high), 0)::DOUBLE / (2.0::DOUBLE * sum(pos) * sum(neg)), 9) AS error
       FROM steps GROUP BY status""",
)
def auc_bucketed(t: Tables):
    """Area under the curve of prices per order status from a bounded summary, with its error bound."""
    scored = t.orders.select(
        F.col("o_orderstatus").alias("status"), "o_totalprice", F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0).alias("label")
    )
    found = curves.bucketed_auc(scored, "o_totalprice", "label", ["status"])
    return found.select("status", F.round("auc", 9).alias("auc"), F.round("error", 9).alias("error"))

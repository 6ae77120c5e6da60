"""Order-dependent operators: fills, folds, running curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import curves, timeorder
from .base import Tables, query, rounded


_FILL_SQL = """SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'view' THEN value END IGNORE NULLS)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value,
              last_value(CASE WHEN event_type = 'error' THEN event_type END IGNORE NULLS)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error
       FROM events"""


def _fill(t: Tables, **options):
    events = t.events.select(
        "event_id",
        "user_id",
        "ts",
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "error", F.col("event_type")).alias("last_error"),
    )
    filled = timeorder.forward_fill(events, ["user_id"], ["ts", "event_id"], ["value", "last_error"], **options)
    return filled.drop("ts")


@query("forward_fill", _FILL_SQL)
def forward_fill(t: Tables):
    return _fill(t)


@query("forward_fill_hot", _FILL_SQL)
def forward_fill_hot(t: Tables):
    """The same over range partitions, as for groups too large for one task."""
    return _fill(t, group_limit=0)


@query(
    "running_totals",
    """SELECT event_id, event_type,
              CAST(sum(floor(value * 100 + 0.5)) OVER w AS BIGINT) AS total,
              CAST(count(*) OVER w AS BIGINT) AS seen, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next_user
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_totals(t: Tables):
    """The two-level scan, taken whatever the group sizes, on five hot groups."""
    cents = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    scanned = timeorder.running_sums(
        t.events.select("event_id", "event_type", "ts", "user_id", "value"),
        ["event_type"],
        [F.col("ts").asc(), F.col("event_id").asc()],
        {"total": cents, "seen": F.lit(1).cast("bigint")},
        {"next_user": F.col("user_id")},
        group_limit=0,
    )
    return scanned.select("event_id", "event_type", "total", "seen", "next_user")


_FOLDS_SQL = """
 numbered AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
                     row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)"""


@query(
    "time_series_folds",
    f"""WITH {_FOLDS_SQL}
       SELECT o_orderkey, CAST(i AS BIGINT) AS row_index, CAST(n AS BIGINT) AS row_total,
              CAST(CASE WHEN i < n - 3 * (n // 4) THEN -1 ELSE (i - (n - 3 * (n // 4))) // (n // 4) END AS INTEGER) AS test_fold
       FROM numbered""",
)
def time_series_folds(t: Tables):
    orders = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    return timeorder.expanding_folds(orders, ["order_date", "o_orderkey"], 3).drop("order_date")


@query(
    "time_series_fold_sizes",
    f"""WITH {_FOLDS_SQL}, k AS (SELECT unnest(range(7)) AS fold),
       sized AS (SELECT fold, n - (7 - fold) * (n // 8) AS start, n // 8 AS size FROM k, (SELECT any_value(n) AS n FROM numbered))
       SELECT CAST(fold AS INTEGER) AS fold, CAST(start AS BIGINT) AS train_rows, CAST(size AS BIGINT) AS test_rows,
              (SELECT max(order_date) FROM numbered WHERE i < start) AS train_until,
              (SELECT min(order_date) FROM numbered WHERE i >= start AND i < start + size) AS test_from
       FROM sized""",
)
def time_series_fold_sizes(t: Tables):
    """Train and test extent of each of seven folds, counted from the folded rows."""
    orders = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    folded = timeorder.expanding_folds(orders, ["order_date", "o_orderkey"], 7)
    per_block = folded.groupBy("test_fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("order_date").alias("lo"), F.max("order_date").alias("hi")
    )
    parts = F.explode(F.sequence(F.col("test_fold"), F.lit(6))).alias("fold")
    use = per_block.select("test_fold", "n", "lo", "hi", parts).where(F.col("fold") >= 0)
    tests = F.col("test_fold") == F.col("fold")
    return use.groupBy(F.col("fold").cast("int").alias("fold")).agg(
        F.sum(F.when(~tests, F.col("n")).otherwise(0)).cast("bigint").alias("train_rows"),
        F.sum(F.when(tests, F.col("n")).otherwise(0)).cast("bigint").alias("test_rows"),
        F.max(F.when(~tests, F.col("hi"))).alias("train_until"),
        F.min(F.when(tests, F.col("lo"))).alias("test_from"),
    )


@query(
    "period_folds",
    """WITH months AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS month FROM orders),
            numbered AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM months)
       SELECT o_orderkey, month,
              CAST(CASE WHEN i < n - 3 * (n // 4) THEN -1 ELSE (i - (n - 3 * (n // 4))) // (n // 4) END AS INTEGER) AS test_fold
       FROM orders JOIN numbered ON month = last_day(CAST(o_orderdate AS DATE))""",
)
def period_folds(t: Tables):
    orders = t.orders.select("o_orderkey", F.last_day(F.col("o_orderdate").cast("date")).alias("month"))
    return timeorder.period_folds(orders, "month", 3)


def scored_lines(t: Tables):
    """Line items with a score, a label, a model name and a fold."""
    return t.lineitem.select(
        F.col("l_discount").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_linestatus").alias("model"),
        F.pmod(F.month("l_shipdate"), F.lit(7)).cast("int").alias("fold"),
    )


SCORED_SQL = """
 scored AS (SELECT l_discount AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
                   l_linestatus AS model, CAST(month(l_shipdate) % 7 AS INTEGER) AS fold FROM lineitem)"""

STEPS_SQL = """
 counted AS (SELECT {g} score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY ALL),
 steps AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER (PARTITION BY {p} ORDER BY score DESC) AS next_pos,
                  lead(neg) OVER (PARTITION BY {p} ORDER BY score DESC) AS next_neg,
                  sum(pos) OVER (PARTITION BY {p}) AS positives, sum(neg) OVER (PARTITION BY {p}) AS negatives
           FROM counted WINDOW w AS (PARTITION BY {p} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "roc_points",
    f"""WITH {SCORED_SQL}, {STEPS_SQL.format(g='', p='1')}
       SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS tp, 0.0 AS fpr, 0.0 AS tpr
       UNION ALL
       SELECT score, CAST(fp AS BIGINT), CAST(tp AS BIGINT), fp / negatives, tp / positives FROM steps
       WHERE next_pos IS NULL OR tp = pos AND fp = neg OR NOT (next_pos = pos AND next_neg = neg)""",
)
def roc_points(t: Tables):
    return curves.roc_curve(scored_lines(t), "score", "label")


@query(
    "roc_points_prices",
    f"""WITH scored AS (SELECT l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
                   l_linestatus AS model FROM lineitem), {STEPS_SQL.format(g='model,', p='model')}
       SELECT model, CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS tp, 0.0 AS fpr, 0.0 AS tpr
       FROM steps GROUP BY model
       UNION ALL
       SELECT model, score, CAST(fp AS BIGINT), CAST(tp AS BIGINT), fp / negatives, tp / positives FROM steps
       WHERE next_pos IS NULL OR tp = pos AND fp = neg OR NOT (next_pos = pos AND next_neg = neg)""",
)
def roc_points_prices(t: Tables):
    """Nearly as many thresholds as rows, so the running counts cross many partitions."""
    lines = t.lineitem.select(
        F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_linestatus").alias("model"),
    )
    return curves.roc_curve(lines, "score", "label", ["model"], group_limit=0)


_AREA_SQL = "sum(neg * (2 * tp - pos)) / (2.0 * any_value(positives) * any_value(negatives))"


@query(
    "auc_trapezoid",
    f"""WITH {SCORED_SQL}, {STEPS_SQL.format(g='model, fold,', p='model, fold')}
       SELECT model, fold, round({_AREA_SQL}, 9) AS auc FROM steps GROUP BY ALL""",
)
def auc_trapezoid(t: Tables):
    found = curves.auc(scored_lines(t), "score", "label", ["model", "fold"])
    return found.withColumn("auc", rounded("auc", 9))


_GRID_SQL = f"""
 grid AS (
  SELECT model, fold, j, CASE WHEN j = 0 THEN 0.0 ELSE
         ((tp - pos) + (j * negatives - (fp - neg) * 99) / (neg * 99.0) * pos) / positives END AS tpr
  FROM (SELECT *, unnest(range(CAST(((fp - neg) * 99 + negatives - 1) // negatives AS BIGINT),
                               CAST((fp * 99 + negatives - 1) // negatives AS BIGINT))) AS j
        FROM steps WHERE neg > 0)
  UNION ALL SELECT DISTINCT model, fold, 99, 1.0 FROM steps),
 band AS (
  SELECT model, j, CASE WHEN j = 99 THEN 1.0 ELSE avg(tpr) END AS m, stddev_pop(tpr) AS s FROM grid GROUP BY model, j)"""


@query(
    "roc_grid",
    f"""WITH {SCORED_SQL}, {STEPS_SQL.format(g='model, fold,', p='model, fold')}, {_GRID_SQL}
       SELECT model, fold, CAST(j AS INTEGER) AS grid, round(j / 99.0, 9) AS fpr, round(tpr, 9) AS tpr FROM grid""",
)
def roc_grid(t: Tables):
    """Interpolated curve of every model and fold on 100 grid points."""
    steps = curves.roc_steps(scored_lines(t), "score", "label", ["model", "fold"])
    grid = curves.roc_on_grid(steps, ["model", "fold"])
    return grid.withColumns({"fpr": rounded("fpr", 9), "tpr": rounded("tpr", 9)})


@query(
    "roc_band",
    f"""WITH {SCORED_SQL}, {STEPS_SQL.format(g='model, fold,', p='model, fold')}, {_GRID_SQL}
       SELECT model, CAST(j AS INTEGER) AS grid, round(j / 99.0, 6) AS fpr, round(m, 6) AS mean_tpr,
              round(greatest(m - s, 0), 6) AS lower, round(least(m + s, 1), 6) AS upper FROM band""",
)
def roc_band(t: Tables):
    band, _ = curves.roc_band(scored_lines(t), "score", "label")
    return band.select("model", "grid", *[rounded(c).alias(c) for c in ("fpr", "mean_tpr", "lower", "upper")])


@query(
    "roc_band_auc",
    f"""WITH {SCORED_SQL}, {STEPS_SQL.format(g='model, fold,', p='model, fold')}, {_GRID_SQL},
       areas AS (SELECT model, fold, {_AREA_SQL} AS auc FROM steps GROUP BY ALL),
       trapezes AS (SELECT model, (j - lag(j) OVER w) / 99.0 * (m + lag(m) OVER w) / 2 AS a FROM band
                    WINDOW w AS (PARTITION BY model ORDER BY j))
       SELECT model, round(mean_auc, 6) AS mean_auc, round(std_auc, 6) AS std_auc, folds
       FROM (SELECT model, sum(a) AS mean_auc FROM trapezes GROUP BY 1)
       JOIN (SELECT model, stddev_pop(auc) AS std_auc, CAST(count(*) AS BIGINT) AS folds FROM areas GROUP BY 1) USING (model)""",
)
def roc_band_auc(t: Tables):
    _, areas = curves.roc_band(scored_lines(t), "score", "label")
    return areas.withColumns({"mean_auc": rounded("mean_auc"), "std_auc": rounded("std_auc")})

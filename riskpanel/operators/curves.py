"""ROC curves, areas and bands as relational operations.

Scores are first reduced to one row per distinct score. Running counts come
from ``timeorder``, which never scans an unbounded group in one task. Every counted row knows the point before it (its running
counts minus its own counts), which gives areas and interpolation without a
lag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .columns import quoted
from .timeorder import GROUP_LIMIT, running_sums

GRID_POINTS = 100
# Buckets of a score summary, per group.
BUCKETS = 4096


def score_counts(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*groups, quoted(score).alias("score")).agg(
        F.count_if(quoted(label) == 1).cast("bigint").alias("pos"),
        F.count_if(quoted(label) != 1).cast("bigint").alias("neg"),
    )


def roc_steps(
    df: DataFrame, score: str, label: str, groups: Sequence[str] = (), group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Running counts per distinct score, highest score first, with the group totals."""
    groups = list(groups)
    # Read three times below: one row per distinct score, written once.
    counts = cut_lineage(score_counts(df, score, label, groups))
    steps = running_sums(
        counts,
        groups,
        [F.col("score").desc()],
        {"tp": F.col("pos"), "fp": F.col("neg")},
        {"next_pos": F.col("pos"), "next_neg": F.col("neg")},
        group_limit,
    )
    totals = counts.groupBy(*groups).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    if groups:
        return steps.join(totals, groups, "left")
    row = totals.first()
    return steps.withColumns(
        {"positives": F.lit(row["positives"]).cast("bigint"), "negatives": F.lit(row["negatives"]).cast("bigint")}
    )


def _rates() -> dict[str, Column]:
    return {
        "fpr": F.try_divide(F.col("fp").cast("double"), F.col("negatives").cast("double")),
        "tpr": F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")),
    }


def roc_curve(
    df: DataFrame,
    score: str,
    label: str,
    groups: Sequence[str] = (),
    drop_collinear: bool = True,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Points (fpr, tpr, threshold) per group, with a leading (0, 0) without a threshold.

    ``drop_collinear`` leaves out inner points on a straight line: those whose
    counts equal the counts of the next score.
    """
    groups = list(groups)
    steps = roc_steps(df, score, label, groups, group_limit)
    first = steps.select(*groups).distinct() if groups else None
    if drop_collinear:
        inner = (
            (F.col("next_pos") == F.col("pos"))
            & (F.col("next_neg") == F.col("neg"))
            & ~((F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg")))
        )
        steps = steps.where(~F.coalesce(inner, F.lit(False)))
    points = steps.select(*groups, F.col("score").alias("threshold"), "fp", "tp", *[v.alias(k) for k, v in _rates().items()])
    if first is None:
        first = df.sparkSession.range(1)
    zero = first.select(
        *groups,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("bigint").alias("fp"),
        F.lit(0).cast("bigint").alias("tp"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return zero.unionByName(points)


def auc_from_steps(steps: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area from running counts; exact integers until the last division."""
    # Twice the area in units of (negative x positive): width x (left height + right height).
    doubled = F.sum((F.col("neg") * (F.lit(2) * F.col("tp") - F.col("pos"))).cast("decimal(38,0)"))
    box = F.max(F.col("positives").cast("double") * F.col("negatives").cast("double") * 2)
    return steps.groupBy(*groups).agg(F.try_divide(doubled.cast("double"), box).alias("auc"))


def auc(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    return auc_from_steps(roc_steps(df, score, label, groups), groups)


def bucket_counts(
    df: DataFrame, score: str, label: str, groups: Sequence[str] = (), buckets: int = BUCKETS, bounds: tuple[float, float] | None = None
) -> DataFrame:
    """Mergeable summary of scores: positives, negatives and the range of the scores per group and bucket of equal width.

    At most ``buckets`` rows a group are shuffled, however many scores there are.
    ``bounds`` are those of all scores unless given; summaries made with the same
    bounds are merged by ``merge_buckets``. Rows without a score are left out.
    """
    groups = list(groups)
    rows = df.where(quoted(score).isNotNull()).select(*groups, quoted(score).cast("double").alias("score"), quoted(label).alias("label"))
    if bounds is None:
        found = rows.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
        bounds = (found["low"] or 0.0, found["high"] or 0.0)
    low, width = bounds[0], bounds[1] - bounds[0]
    place = F.floor((F.col("score") - F.lit(low)) / F.lit(width) * F.lit(buckets)) if width > 0 else F.lit(0)
    bucket = F.greatest(F.least(place, F.lit(buckets - 1)), F.lit(0)).cast("int")
    return rows.groupBy(*groups, bucket.alias("bucket")).agg(
        F.count_if(F.col("label") == 1).cast("bigint").alias("pos"),
        F.count_if(F.col("label") != 1).cast("bigint").alias("neg"),
        F.min("score").alias("low"), F.max("score").alias("high"),
    )


def merge_buckets(summary: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One summary of the union of several with the same buckets."""
    return summary.groupBy(*groups, "bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def auc_of_buckets(summary: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, auc, error) of a summary: the exact area is within ``error`` of ``auc``.

    Only pairs of a positive and a negative in one bucket are in doubt; they
    count as ties. A bucket with a single score holds real ties, so the area is
    exact where every mixed bucket has one.
    """
    groups = list(groups)
    # A group has no more rows than there are buckets.
    order = Window.partitionBy(*groups).orderBy(F.col("bucket").desc())
    steps = summary.withColumn("tp", F.sum("pos").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    doubled = F.sum((F.col("neg") * (F.lit(2) * F.col("tp") - F.col("pos"))).cast("decimal(38,0)"))
    doubt = F.sum(F.when(F.col("low") < F.col("high"), F.col("pos") * F.col("neg")).otherwise(0).cast("decimal(38,0)"))
    box = F.sum("pos").cast("double") * F.sum("neg").cast("double") * 2
    return steps.groupBy(*groups).agg(
        F.try_divide(doubled.cast("double"), box).alias("auc"), F.try_divide(doubt.cast("double"), box).alias("error")
    )


def bucketed_auc(df: DataFrame, score: str, label: str, groups: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    return auc_of_buckets(bucket_counts(df, score, label, groups, buckets), groups)


def auc_of_points(points: DataFrame, x: str, y: str, groups: Sequence[str]) -> DataFrame:
    """Trapezoid area under given points, at most a grid per group."""
    order = Window.partitionBy(*groups).orderBy(quoted(x), quoted(y))
    steps = points.select(
        *groups,
        quoted(x).alias("__x"),
        quoted(y).alias("__y"),
        F.lag(quoted(x)).over(order).alias("__px"),
        F.lag(quoted(y)).over(order).alias("__py"),
    )
    area = F.sum((F.col("__x") - F.col("__px")) * (F.col("__y") + F.col("__py")) / 2)
    return steps.groupBy(*groups).agg(area.alias("auc"))


def roc_on_grid(steps: DataFrame, groups: Sequence[str], points: int = GRID_POINTS) -> DataFrame:
    """Interpolated tpr on an even fpr grid per group.

    Each curve segment emits just the grid points it covers, so the result has
    ``points`` rows per group and no join with a grid takes place. Positions
    are compared as integers. Where the curve jumps, the upper value counts;
    the first value is forced to 0.
    """
    last = points - 1
    begin = F.col("fp") - F.col("neg")
    ceiling = "({0} * %d + negatives - 1) div negatives" % last
    low, high = F.expr(ceiling.format("(fp - neg)")), F.expr(ceiling.format("fp")) - 1
    segments = steps.where((F.col("neg") > 0) & (F.col("positives") > 0)).select(
        *groups,
        "neg",
        "pos",
        "positives",
        "negatives",
        begin.alias("__begin"),
        (F.col("tp") - F.col("pos")).alias("__low"),
        F.explode(F.when(low <= high, F.sequence(low, high))).alias("grid"),
    )
    share = (F.col("grid") * F.col("negatives") - F.col("__begin") * last) / (F.col("neg") * F.lit(float(last)))
    height = (F.col("__low") + share * F.col("pos")) / F.col("positives")
    inner = segments.select(
        *groups,
        F.col("grid").cast("int").alias("grid"),
        F.when(F.col("grid") == 0, F.lit(0.0)).otherwise(height).alias("tpr"),
    )
    ends = (
        steps.where((F.col("positives") > 0) & (F.col("negatives") > 0))
        .select(*groups)
        .distinct()
        .select(*groups, F.lit(last).alias("grid"), F.lit(1.0).alias("tpr"))
    )
    return inner.unionByName(ends).select(
        *groups, "grid", (F.col("grid") / F.lit(float(last))).alias("fpr"), "tpr"
    )


def roc_band(
    df: DataFrame,
    score: str,
    label: str,
    model: str = "model",
    fold: str = "fold",
    points: int = GRID_POINTS,
) -> tuple[DataFrame, DataFrame]:
    """Mean ROC of the folds with one standard deviation around it, per model.

    Returns (model, grid, fpr, mean_tpr, lower, upper) and (model, mean_auc,
    std_auc). Standard deviations are those of the population. Folds with one
    class only have no curve and do not take part.
    """
    steps = roc_steps(df, score, label, [model, fold])
    grid = roc_on_grid(steps, [model, fold], points)
    band = (
        grid.groupBy(model, "grid", "fpr")
        .agg(F.avg("tpr").alias("__mean"), F.stddev_pop("tpr").alias("__std"))
        .withColumn("mean_tpr", F.when(F.col("grid") == points - 1, F.lit(1.0)).otherwise(F.col("__mean")))
        .select(
            model,
            "grid",
            "fpr",
            "mean_tpr",
            F.greatest(F.col("mean_tpr") - F.col("__std"), F.lit(0.0)).alias("lower"),
            F.least(F.col("mean_tpr") + F.col("__std"), F.lit(1.0)).alias("upper"),
        )
    )
    mean_auc = auc_of_points(band, "fpr", "mean_tpr", [model]).withColumnRenamed("auc", "mean_auc")
    spread = (
        auc_from_steps(steps, [model, fold])
        .groupBy(model)
        .agg(F.stddev_pop("auc").alias("std_auc"), F.count("auc").cast("bigint").alias("folds"))
    )
    return band, mean_auc.join(spread, model)

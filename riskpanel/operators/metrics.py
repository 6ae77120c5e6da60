"""Classification metrics from one pass of conditional counts. Labels and predictions are 0 or 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import bin_index, f1_score, safe_ratio
from .columns import quoted

# Edges of the low, middle and high risk level.
RISK_EDGES = (0.0, 0.3, 0.7, 1.0)


def confusion_cells(
    df: DataFrame, label: str = "label", prediction: str = "prediction", groups: Sequence[str] = ()
) -> DataFrame:
    """One row per group with tn, fp, fn, tp."""
    real = quoted(label) == 1
    said = quoted(prediction) == 1

    def count(condition: Column) -> Column:
        return F.count_if(condition).cast("bigint")

    return df.groupBy(*groups).agg(
        count(~real & ~said).alias("tn"),
        count(~real & said).alias("fp"),
        count(real & ~said).alias("fn"),
        count(real & said).alias("tp"),
    )


def confusion_matrix(cells: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Long 2 x 2 matrix (actual, predicted, n), cells with no rows included."""
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
            for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return cells.select(*groups, F.inline(entries))


def metric_columns() -> dict[str, Column]:
    """Metrics as expressions over tn, fp, fn, tp; undefined ratios are null."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    rows = tn + fp + fn + tp
    observed = F.try_divide(tn + tp, rows)
    expected = F.try_divide((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), rows * rows)
    recall = safe_ratio(tp, tp + fn)
    specificity = safe_ratio(tn, tn + fp)
    precision = safe_ratio(tp, tp + fp)
    # A class that is neither true nor predicted anywhere does not take part in the macro mean.
    present = F.when(tp + fn + fp > 0, 1).otherwise(0) + F.when(tn + fp + fn > 0, 1).otherwise(0)
    macro = F.try_divide(F.coalesce(recall, F.lit(0.0)) + F.coalesce(specificity, F.lit(0.0)), present)
    return {
        "accuracy": observed,
        "kappa": F.try_divide(observed - expected, F.lit(1.0) - expected),
        "auc": (recall + specificity) / 2,
        "recall": recall,
        "precision": precision,
        "f1": f1_score(precision, recall),
        "recall_macro": macro,
    }


def classification_metrics(cells: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row of metrics per group; ``auc`` is the area of the hard-label curve."""
    return cells.select(*groups, *[value.alias(name) for name, value in metric_columns().items()])


def long_report(metrics: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, metric, value) rows in place of printed text."""
    names = [c for c in metrics.columns if c not in groups]
    entries = F.array(
        *[F.struct(F.lit(c).alias("metric"), quoted(c).cast("double").alias("value")) for c in names]
    )
    return metrics.select(*groups, F.inline(entries))


def classification_report(cells: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, f1 and support, and their support-weighted average."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def entry(name: str, hit: Column, said: Column, real: Column) -> Column:
        precision = F.coalesce(safe_ratio(hit, said), F.lit(0.0))
        recall = F.coalesce(safe_ratio(hit, real), F.lit(0.0))
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            F.coalesce(f1_score(precision, recall), F.lit(0.0)).alias("f1"),
            real.cast("bigint").alias("support"),
        )

    classes = cells.select(
        *groups, F.inline(F.array(entry("0", tn, tn + fn, tn + fp), entry("1", tp, tp + fp, tp + fn)))
    )
    weighted = classes.groupBy(*groups).agg(
        F.lit("weighted").alias("class"),
        *[
            F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")).alias(c)
            for c in ("precision", "recall", "f1")
        ],
        F.sum("support").cast("bigint").alias("support"),
    )
    return classes.unionByName(weighted)


def risk_histogram(
    df: DataFrame, score: str, edges: Sequence[float] = RISK_EDGES, groups: Sequence[str] = ()
) -> DataFrame:
    """Rows per probability bin, empty bins included, with their share of all binned rows."""
    bins = len(edges) - 1
    counts = df.groupBy(*groups).agg(
        *[F.count_if(bin_index(score, edges) == b).cast("bigint").alias(f"__b{b}") for b in range(bins)]
    )
    total = sum((F.col(f"__b{b}") for b in range(bins)), F.lit(0))
    entries = F.array(
        *[
            F.struct(
                F.lit(b).alias("bin"),
                F.lit(float(edges[b])).alias("low"),
                F.lit(float(edges[b + 1])).alias("high"),
                F.col(f"__b{b}").alias("n"),
                safe_ratio(F.col(f"__b{b}"), total).alias("share"),
            )
            for b in range(bins)
        ]
    )
    return counts.select(*groups, F.inline(entries))


def score_summary(scores: DataFrame, params: Sequence[str], score: str = "score") -> DataFrame:
    """Mean and twice the population deviation of the fold scores per parameter set."""
    return scores.groupBy(*params).agg(
        F.avg(quoted(score)).alias("mean_score"),
        (F.lit(2.0) * F.stddev_pop(quoted(score))).alias("two_std"),
        F.count(quoted(score)).cast("bigint").alias("folds"),
    )

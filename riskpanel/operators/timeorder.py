"""Order-dependent operators that survive a hot key or a hot period.

A window over one big group would run in one task. The size of the largest
group is therefore counted first. Up to ``GROUP_LIMIT`` rows a plain window is
used. Beyond it rows are range partitioned on their total order, so that a hot
group is spread over many partitions; each partition is scanned on its own and
a small table with one row per (group, partition) carries totals from one
partition to the next. The range-partitioned rows are written to the checkpoint
folder, because both steps must see the same partitions. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .columns import quoted

_PID = "__part"

# Largest group that a single task may scan in a window.
GROUP_LIMIT = 1_000_000


def largest_group(df: DataFrame, groups: Sequence[str]) -> int:
    """Rows of the largest group; only the group columns are read and counts are partially aggregated."""
    counts = df.groupBy(*[quoted(g) for g in groups]).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.max("__n")).first()[0] or 0


def range_partitioned(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in total order over partitions, with the partition number as a column."""
    ordered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return ordered.withColumn(_PID, F.spark_partition_id())


def _null_safe_join(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join the small carry table on (group, partition); null groups match."""
    renamed = right.select(
        F.col(_PID).alias("__r_part"),
        *[quoted(g).alias(f"__r_{g}") for g in groups],
        *[c for c in right.columns if c != _PID and c not in groups],
    )
    condition = [left[_PID] == renamed["__r_part"]]
    condition += [left[g].eqNullSafe(renamed[f"__r_{g}"]) for g in groups]
    return left.join(renamed, condition, "left").drop("__r_part", *[f"__r_{g}" for g in groups])


def running_sums(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    following: Mapping[str, Column] | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add cumulative sums per group in the given order (the current row included).

    ``order`` must be unique within a group. ``following`` adds values of the
    next row of the group (null on its last row).
    """
    groups = list(groups)
    following = dict(following or {})
    if largest_group(df, groups) <= group_limit:
        whole = Window.partitionBy(*groups).orderBy(*order)
        upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.coalesce(F.sum(value).over(upto), F.lit(0)).alias(name) for name, value in sums.items()],
            *[F.lead(value).over(whole).alias(name) for name, value in following.items()],
        )
    ordered = range_partitioned(
        df.select(
            "*",
            *[value.alias(f"__in_{name}") for name, value in sums.items()],
            *[value.alias(f"__nx_{name}") for name, value in following.items()],
        ),
        [*[quoted(g).asc() for g in groups], *order],
    )
    totals = ordered.groupBy(_PID, *groups).agg(
        *[F.sum(f"__in_{name}").alias(f"__in_{name}") for name in sums]
    )
    earlier = Window.partitionBy(*groups).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        _PID, *groups, *[F.sum(f"__in_{name}").over(earlier).alias(f"__carry_{name}") for name in sums]
    )
    local = Window.partitionBy(_PID, *groups).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = ordered.select(
        "*",
        *[F.sum(f"__in_{name}").over(upto).alias(f"__run_{name}") for name in sums],
        *[F.lead(f"__nx_{name}").over(local).alias(f"__lead_{name}") for name in following],
        *([F.row_number().over(local).alias("__rn")] if following else []),
    )
    if following:
        heads = scanned.where(F.col("__rn") == 1).select(
            _PID, *groups, *[F.col(f"__nx_{name}") for name in following]
        )
        nearest = Window.partitionBy(*groups).orderBy(_PID)
        heads = heads.select(
            F.col(_PID), *groups, *[F.lead(f"__nx_{name}").over(nearest).alias(f"__head_{name}") for name in following]
        )
        carry = _null_safe_join(carry, heads, groups)
    joined = _null_safe_join(scanned, carry, groups)
    return joined.select(
        *[quoted(c) for c in df.columns],
        *[
            (
                F.coalesce(F.col(f"__carry_{name}"), F.lit(0)) + F.coalesce(F.col(f"__run_{name}"), F.lit(0))
            ).alias(name)
            for name in sums
        ],
        *[
            F.coalesce(F.col(f"__lead_{name}"), F.col(f"__head_{name}")).alias(name)
            for name in following
        ],
    )


def forward_fill(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Replace nulls by the last earlier value of the group; ``order`` must be unique in a group."""
    groups = list(groups)
    sort = [quoted(c).asc() for c in order]
    if largest_group(df, groups) <= group_limit:
        window = Window.partitionBy(*groups).orderBy(*sort)
        seen = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            *[
                F.last(quoted(c), ignorenulls=True).over(seen).alias(c) if c in columns else quoted(c)
                for c in df.columns
            ]
        )
    ordered = range_partitioned(df, [*[quoted(g).asc() for g in groups], *sort])
    key = F.struct(*[quoted(c) for c in order])
    # Null order keys would leave max_by without a winner; a struct is never null itself.
    last_known = ordered.groupBy(_PID, *groups).agg(
        *[F.max_by(quoted(c), F.when(quoted(c).isNotNull(), key)).alias(f"__last_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*groups).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = last_known.select(
        _PID,
        *groups,
        *[F.last(f"__last_{c}", ignorenulls=True).over(earlier).alias(f"__carry_{c}") for c in columns],
    )
    upto = (
        Window.partitionBy(_PID, *groups)
        .orderBy(*sort)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = ordered.select(
        "*", *[F.last(quoted(c), ignorenulls=True).over(upto).alias(f"__run_{c}") for c in columns]
    )
    joined = _null_safe_join(scanned, carry, groups)
    return joined.select(
        *[
            F.coalesce(F.col(f"__run_{c}"), F.col(f"__carry_{c}")).alias(c) if c in columns else quoted(c)
            for c in df.columns
        ]
    )


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in the total order, and the number of rows.

    Inside a sorted partition the row number comes from
    ``monotonically_increasing_id``; a carry table of one row per partition
    brings the rows before it, so the plan does not grow with the partitions.
    """
    ordered = range_partitioned(df, [quoted(c).asc() for c in order]).withColumn(
        "__local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = ordered.groupBy(_PID).agg(F.count(F.lit(1)).alias("__size"))
    # As many rows as partitions, which the driver plans one by one anyway.
    whole = Window.orderBy(_PID)
    carry = sizes.select(
        _PID,
        F.coalesce(F.sum("__size").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__size").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("row_total"),
    )
    joined = ordered.join(F.broadcast(carry), _PID)
    return joined.select(*[quoted(c) for c in df.columns], (F.col("__before") + F.col("__local")).alias(name), "row_total")


def expanding_folds(df: DataFrame, order: Sequence[str], n_splits: int) -> DataFrame:
    """Add ``row_index``, ``row_total`` and ``test_fold`` of an expanding time split.

    With n rows the test blocks have ``n // (n_splits + 1)`` rows and lie at
    the end; block i is tested by fold i and everything before it trains that
    fold. Rows before the first test block have fold -1.
    """
    indexed = row_index(df, order)
    size = F.expr(f"row_total div {n_splits + 1}")
    start = F.col("row_total") - size * n_splits
    fold = F.when(F.col("row_index") < start, F.lit(-1)).otherwise(
        F.floor((F.col("row_index") - start) / F.greatest(size, F.lit(1)))
    )
    return indexed.withColumn("test_fold", fold.cast("int"))


def period_folds(df: DataFrame, period: str, n_splits: int) -> DataFrame:
    """Like ``expanding_folds`` but on whole periods, so that no period is split."""
    periods = df.select(quoted(period).alias("__p")).distinct()
    folds = expanding_folds(periods, ["__p"], n_splits).select("__p", "test_fold")
    return df.join(folds, quoted(period) == F.col("__p"), "left").drop("__p")


def fold_train(folded: DataFrame, fold: int) -> DataFrame:
    return folded.where(F.col("test_fold") < fold)


def fold_test(folded: DataFrame, fold: int) -> DataFrame:
    return folded.where(F.col("test_fold") == fold)

"""Aggregates, ordering and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .columns import quoted


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency per non-null value."""
    return df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias(column)).agg(
        F.count(F.lit(1)).alias("n")
    )


def group_profile(
    df: DataFrame,
    keys: Sequence[str],
    modes: Sequence[str],
    means: Sequence[str],
    exact_scale: int | None = None,
) -> DataFrame:
    """Most frequent value and mean per group; rows with a null key are dropped.

    Ties go to the smallest value and a group without any value has a null mode.
    One scan counts every (group, value) pair through grouping sets, so a group
    that holds a large share of the rows is reduced on the map side instead of
    being carried in one aggregation buffer; a second small aggregate picks the
    winners. With ``exact_scale`` means are taken over decimals of that scale
    and do not depend on the row order.
    """
    rows = df.na.drop(how="any", subset=list(keys))
    exact = None if exact_scale is None else f"decimal(18,{exact_scale})"

    def number(column: str) -> Column:
        return quoted(column) if exact is None else quoted(column).cast(exact)

    parts = [F.sum(number(c)).alias(f"__sum_{c}") for c in means]
    parts += [F.count(number(c)).alias(f"__cnt_{c}") for c in means]
    if not modes:
        totals = rows.groupBy(*keys).agg(*(parts or [F.count(F.lit(1)).alias("__n")]))
        return totals.select(*keys, *[_mean_of(c).alias(c) for c in means])

    counted = rows.groupingSets(
        [[F.col(k) for k in keys] + [quoted(c)] for c in modes],
        *[F.col(k) for k in keys],
        *[quoted(c) for c in modes],
    ).agg(F.count(F.lit(1)).alias("__n"), F.grouping_id().alias("__set"), *parts)
    # In a grouping id the bit of each column left out of the set is on.
    everything = 2 ** len(modes) - 1
    set_of = {c: everything - 2 ** (len(modes) - 1 - i) for i, c in enumerate(modes)}
    picked = [
        F.min(
            F.when(
                (F.col("__set") == set_of[c]) & quoted(c).isNotNull(),
                F.struct((-F.col("__n")).alias("n"), quoted(c).alias("v")),
            )
        )["v"].alias(c)
        for c in modes
    ]
    first_set = F.col("__set") == set_of[modes[0]]
    sums = [
        F.sum(F.when(first_set, quoted(f"__{kind}_{c}"))).alias(f"__{kind}_{c}")
        for c in means
        for kind in ("sum", "cnt")
    ]
    best = counted.groupBy(*keys).agg(*picked, *sums)
    return best.select(*keys, *[quoted(c) for c in modes], *[_mean_of(c).alias(c) for c in means])


def _mean_of(column: str) -> Column:
    return F.try_divide(
        quoted(f"__sum_{column}").cast("double"), quoted(f"__cnt_{column}").cast("double")
    )


def top_k(df: DataFrame, value: str, k: int, tie_break: Sequence[str], descending: bool = True) -> DataFrame:
    """First ``k`` rows by value; ties are ordered by ``tie_break``."""
    first = quoted(value).desc() if descending else quoted(value).asc()
    return df.orderBy(first, *[quoted(c).asc() for c in tie_break]).limit(k)


def best_row(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """The row with the largest value, the first one by ``order`` on ties; nulls never win."""
    return top_k(df.where(quoted(value).isNotNull()), value, 1, order)


def rows_at_max(df: DataFrame, value: str) -> DataFrame:
    """All rows that share the largest value."""
    best = df.agg(F.max(quoted(value)).alias("__best"))
    return df.join(best, quoted(value) == F.col("__best"), "left_semi")


def union_all_names(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; a column missing in one table is null there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result

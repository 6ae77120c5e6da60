"""Row filters with the null rules spelled out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import matches_from_start


# Largest number of values that is checked row by row instead of joined.
MAX_LISTED = 10_000


def differs(column: Column | str, *values) -> Column:
    """``column`` is none of the values; a null differs from every value and is kept."""
    column = F.col(column) if isinstance(column, str) else column
    return reduce(lambda left, right: left & right, [~column.eqNullSafe(F.lit(v)) for v in values])


def not_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Drop rows whose text matches at its start; a null text matches nothing and is kept."""
    return df.where(~F.coalesce(matches_from_start(column, pattern), F.lit(False)))


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def date_range(
    df: DataFrame, column: str, after: str | None = None, until: str | None = None
) -> DataFrame:
    """Rows with ``after < column <= until``; a missing date is dropped by either bound."""
    if after is not None:
        df = df.where(F.col(column) > F.lit(after).cast("date"))
    if until is not None:
        df = df.where(F.col(column) <= F.lit(until).cast("date"))
    return df


def drop_rare(
    df: DataFrame,
    column: str,
    min_count: int,
    exempt_prefix: str | None = None,
    max_listed: int = MAX_LISTED,
) -> DataFrame:
    """Drop rows whose value occurs fewer than ``min_count`` times.

    Counts are taken once on the values as they are. Values that start with
    ``exempt_prefix`` and null values always stay. The counts are partially
    aggregated before their shuffle. Up to ``max_listed`` rare values are
    filtered in place, so the rows are not shuffled and a frequent value is no
    hot spot; beyond that an anti join does the same.
    """
    rare = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("__rare"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") < min_count)
        .select("__rare")
    )
    if exempt_prefix is not None:
        rare = rare.where(~F.col("__rare").startswith(exempt_prefix))
    listed = [row[0] for row in rare.limit(max_listed + 1).collect()]
    if len(listed) > max_listed:
        return df.join(rare, df[column] == rare["__rare"], "left_anti")
    if not listed:
        return df
    return df.where(F.col(column).isNull() | ~F.col(column).isin(listed))

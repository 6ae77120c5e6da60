"""Numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scaled_key(value: Column | str, scale: int = 100) -> Column:
    """Exact integer key from a decimal text such as ``4.02`` (402), never through a double."""
    exact = _col(value).try_cast("decimal(18,6)")
    return F.round(exact * F.lit(scale), 0).cast("bigint")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null when the bottom is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def f1_score(precision: Column, recall: Column) -> Column:
    return F.try_divide(F.lit(2.0) * precision * recall, precision + recall)


def money_sum(value: Column | str) -> Column:
    """Sum of amounts in exact decimals, so the result does not depend on the row order."""
    return F.sum(_col(value).cast("decimal(18,2)")).cast("double")


def bin_index(value: Column | str, edges: Sequence[float]) -> Column:
    """Index of the bin that holds the value; bins are left-closed and the last one also right-closed."""
    value = _col(value)
    bins = len(edges) - 1
    index = F.lit(None).cast("int")
    for number in range(bins):
        upper = value <= edges[number + 1] if number == bins - 1 else value < edges[number + 1]
        index = F.when((value >= edges[number]) & upper, F.lit(number)).otherwise(index)
    return index

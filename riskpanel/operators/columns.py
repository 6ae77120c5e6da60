"""Schema operators: dropping, renaming, filling and one-hot encoding columns.

Several of them decide the column list from the data. Each of those runs one
aggregate that returns a single row (or a guarded list of categories) and then
builds a plan with a fixed schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.text import LABEL_SEPARATOR, split_labels

MAX_CATEGORIES = 10_000


def quoted(name: str) -> Column:
    """Column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def drop_columns(df: DataFrame, names: Iterable[str], strict: bool = True) -> DataFrame:
    """Drop by name; ``strict`` raises on an absent column."""
    names = list(names)
    absent = [name for name in names if name not in df.columns]
    if strict and absent:
        raise KeyError(f"columns not found: {absent}")
    gone = set(names)
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def drop_positions(df: DataFrame, positions: Iterable[int]) -> DataFrame:
    return drop_columns(df, [df.columns[p] for p in positions])


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if not c.startswith(prefix)])


def rename_position(df: DataFrame, position: int, name: str) -> DataFrame:
    columns = list(df.columns)
    columns[position] = name
    return df.toDF(*columns)


def promote_header(df: DataFrame, marker: str) -> DataFrame:
    """Use the data row whose first column equals ``marker`` as the column names and drop it."""
    first = quoted(df.columns[0])
    header = df.where(first == marker).limit(1).collect()
    if not header:
        raise ValueError(f"no header row starting with {marker!r}")
    names = [str(v).strip() if v is not None else c for v, c in zip(header[0], df.columns)]
    return df.where(~first.eqNullSafe(F.lit(marker))).toDF(*names)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def non_null_counts(df: DataFrame) -> DataFrame:
    """One row: the row count and, per column, the number of non-null values."""
    return df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(quoted(c)).alias(c) for c in df.columns]
    )


def dense_columns(
    df: DataFrame, min_count: int | None = None, min_fraction: float | None = None
) -> list[str]:
    """Columns with enough values, by an absolute count or by a fraction of the rows."""
    if (min_count is None) == (min_fraction is None):
        raise ValueError("give either min_count or min_fraction")
    counts = non_null_counts(df).first().asDict()
    bar = min_count if min_count is not None else counts["__rows"] * min_fraction
    return [c for c in df.columns if counts[c] >= bar]


def drop_sparse(
    df: DataFrame, min_count: int | None = None, min_fraction: float | None = None
) -> DataFrame:
    return df.select(*[quoted(c) for c in dense_columns(df, min_count, min_fraction)])


def frequent_columns(sums: Mapping[str, float | None], rows: int, ratio: float) -> list[str]:
    """Names whose sum reaches ``rows * ratio``; a negative or missing sum never does."""
    return [name for name, total in sums.items() if total is not None and total >= rows * ratio]


def drop_low_sum(df: DataFrame, ratio: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop numeric columns whose sum is below ``ratio`` times the number of rows."""
    candidates = [c for c in (columns or df.columns) if is_numeric(df, c)]
    totals = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.coalesce(F.sum(quoted(c)), F.lit(0)).cast("double").alias(c) for c in candidates],
    ).first().asDict()
    rows = totals.pop("__rows")
    keep = set(frequent_columns(totals, rows, ratio))
    return df.select(*[quoted(c) for c in df.columns if c in keep or c not in candidates])


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls by 0 in numeric columns, keeping their types."""
    targets = set(columns or [c for c in df.columns if is_numeric(df, c)])
    return df.select(
        *[
            F.coalesce(quoted(c), F.lit(0).cast(df.schema[c].dataType)).alias(c)
            if c in targets
            else quoted(c)
            for c in df.columns
        ]
    )


def fill_from(df: DataFrame, column: str, *others: Column | str) -> DataFrame:
    """Fill one column from other expressions of the same row, such as a constant of its group."""
    choices = [F.col(o) if isinstance(o, str) else o for o in others]
    return df.withColumn(column, F.coalesce(quoted(column), *choices))


def feature_name(prefix: str, value) -> str:
    """``<prefix>__<value>`` without the characters that break column resolution."""
    return f"{prefix}__" + re.sub(r"[.`]", "_", str(value))


def feature_names(prefix: str, values: Sequence) -> dict:
    """Value to column name, with a number appended where two values share a name."""
    names: dict = {}
    taken: set[str] = set()
    for value in values:
        name = base = feature_name(prefix, value)
        number = 2
        while name.lower() in taken:
            name = f"{base}_{number}"
            number += 1
        taken.add(name.lower())
        names[value] = name
    return names


def sorted_categories(rows: Iterable, limit: int | None, what: str) -> list:
    values = [row[0] for row in rows]
    if limit is not None and len(values) > limit:
        raise ValueError(f"{what} has more than {limit} values; one-hot columns would be too many")
    return sorted(values)


def _up_to(values: DataFrame, limit: int | None) -> DataFrame:
    """The values, or one more than ``limit`` of them, which is enough to see the excess."""
    return values if limit is None else values.limit(limit + 1)


def categories(df: DataFrame, column: str, limit: int | None = MAX_CATEGORIES) -> list:
    """Sorted distinct non-null values. More than ``limit`` is an error, never a silent cut; None is no limit."""
    rows = _up_to(df.select(quoted(column)).na.drop().distinct(), limit).collect()
    return sorted_categories(rows, limit, column)


def categories_of(
    df: DataFrame, columns: Sequence[str], limit: int | None = MAX_CATEGORIES
) -> dict[str, list]:
    """Sorted distinct values of several columns, as text and read in one job."""
    parts = [
        _up_to(df.select(quoted(c).cast("string").alias("value")).na.drop().distinct(), limit).select(
            "value", F.lit(c).alias("column")
        )
        for c in columns
    ]
    found: dict[str, list] = {c: [] for c in columns}
    for row in reduce(DataFrame.unionByName, parts).collect() if parts else []:
        found[row["column"]].append(row["value"])
    return {c: sorted_categories([(v,) for v in values], limit, c) for c, values in found.items()}


def label_categories(
    df: DataFrame, column: str, separator: str = LABEL_SEPARATOR, limit: int | None = MAX_CATEGORIES
) -> list[str]:
    """Sorted distinct labels of a multi-label column."""
    labels = df.select(quoted(column).alias("__text")).na.drop().distinct()
    labels = labels.select(F.explode(split_labels("__text", separator)).alias("label"))
    return sorted_categories(_up_to(labels.distinct(), limit).collect(), limit, column)


def one_hot(
    df: DataFrame, column: str, values: Sequence | None = None, prefix: str | None = None, limit: int | None = MAX_CATEGORIES
) -> DataFrame:
    """Append one 0/1 column per value; a null value has zeros everywhere."""
    values = categories(df, column, limit) if values is None else values
    names = feature_names(prefix or column, values)
    return df.select(
        "*",
        *[
            F.when(quoted(column) == F.lit(v), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias(n)
            for v, n in names.items()
        ],
    )


def one_hot_labels(
    df: DataFrame,
    column: str,
    values: Sequence[str] | None = None,
    prefix: str | None = None,
    separator: str = LABEL_SEPARATOR,
    limit: int | None = MAX_CATEGORIES,
) -> DataFrame:
    """Append one 0/1 column per label of a multi-label text."""
    values = label_categories(df, column, separator, limit) if values is None else values
    names = feature_names(prefix or column, values)
    labels = df.withColumn("__labels", split_labels(quoted(column), separator))
    return labels.select(
        *[quoted(c) for c in df.columns],
        *[
            F.coalesce(F.array_contains("__labels", v), F.lit(False)).cast("bigint").alias(n)
            for v, n in names.items()
        ],
    )

"""Joins. Strategies are left to Catalyst and adaptive execution: a side is broadcast only when
its measured size is under ``spark.sql.autoBroadcastJoinThreshold``, otherwise rows are shuffled
on the keys and skewed partitions are split at run time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .columns import quoted


def semi_join(df: DataFrame, lookup: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows of ``df`` that have a partner; ``keys`` maps left to right column names."""
    condition = [df[left] == lookup[right] for left, right in keys.items()]
    return df.join(lookup, condition, "left_semi")


def equi_join(
    df: DataFrame, other: DataFrame, keys: Mapping[str, str], how: str = "inner", keep_keys: bool = False
) -> DataFrame:
    """Join on pairs of differently named columns, keeping the left names.

    The right key columns are dropped unless ``keep_keys``.
    """
    renamed = other.select(
        *[quoted(c).alias(f"__k_{c}") for c in keys.values()],
        *[quoted(c) for c in other.columns if keep_keys or c not in keys.values()],
    )
    condition = [df[left] == renamed[f"__k_{right}"] for left, right in keys.items()]
    return df.join(renamed, condition, how).drop(*[f"__k_{right}" for right in keys.values()])


def left_lookup(df: DataFrame, lookup: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Add the lookup's other columns; a key that occurs twice in the lookup yields two rows."""
    return equi_join(df, lookup, keys, "left")


def outer_join_null_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join in which null keys match each other; keys are coalesced.

    Other columns that both sides have get the suffixes ``_x`` and ``_y``, once
    more where an earlier join has used the name.
    """
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    taken = (set(left.columns) | set(right.columns)) - shared

    def named(df: DataFrame, suffix: str) -> DataFrame:
        names = []
        for c in df.columns:
            name = c + suffix if c in shared else c
            while c in shared and name in taken:
                name += suffix
            taken.add(name)
            names.append(quoted(c).alias(name))
        return df.select(*names)

    left, right = named(left, "_x"), named(right, "_y")
    renamed = right.select(
        *[quoted(k).alias(f"__r_{k}") for k in keys],
        *[quoted(c) for c in right.columns if c not in keys],
    )
    condition = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    joined = left.join(renamed, condition, "full")
    return joined.select(
        *[F.coalesce(left[k], renamed[f"__r_{k}"]).alias(k) for k in keys],
        *[left[c] for c in left.columns if c not in keys],
        *[renamed[c] for c in right.columns if c not in keys],
    )


def outer_join_all(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Fold a list of tables by full outer joins on the same keys."""
    return reduce(lambda left, right: outer_join_null_keys(left, right, keys), frames)


def outer_join_dates(
    left: DataFrame, right: DataFrame, left_date: str, right_date: str, keys: Sequence[str]
) -> DataFrame:
    """Full outer join on (date, keys) where the two date columns keep their own names.

    The shared keys are coalesced, the dates are not: a row found on one side
    only keeps a null date of the other side.
    """
    renamed = right.select(
        *[quoted(k).alias(f"__r_{k}") for k in keys],
        *[quoted(c) for c in right.columns if c not in keys],
    )
    condition = [left[left_date] == renamed[right_date]]
    condition += [left[k] == renamed[f"__r_{k}"] for k in keys]
    joined = left.join(renamed, condition, "full")
    return joined.select(
        *[F.coalesce(left[k], renamed[f"__r_{k}"]).alias(k) for k in keys],
        *[left[c] for c in left.columns if c not in keys],
        *[renamed[c] for c in right.columns if c not in keys],
    )


def suffix_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("", "_r"),
) -> DataFrame:
    """Join on shared keys; other columns that exist on both sides get a suffix."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)

    def named(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[quoted(c).alias(c + suffix if c in shared else c) for c in df.columns])

    return named(left, suffixes[0]).join(named(right, suffixes[1]), list(keys), how)


def static_attributes(panel: DataFrame, attributes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join attributes that do not change over time."""
    return panel.join(attributes, list(keys), "left")

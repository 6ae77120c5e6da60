"""Dense (area x period) panels from event tables.

The plan is flat: no grouped Python. Every source is read once and reduced, by
partial aggregation, to one row per (period, area, date, values). Value lists,
period bounds, the label, the cutoff at the first target date and the wide
counts all work on those reduced rows, and the counts are attached to one spine
that holds every period of every area. Counts and spine are partitioned on the
same keys, so attaching further sources needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import next_period_end, period_end, period_range
from ..functions.text import LABEL_SEPARATOR, split_labels
from ..session import cut_lineage, run_parallel, sized_shuffles
from .columns import (
    MAX_CATEGORIES,
    feature_name,
    feature_names,
    fill_zero,
    frequent_columns,
    quoted,
    sorted_categories,
)
from .joins import static_attributes

# Above this many columns per source, counts go through a pivot on pre-counted rows
# instead of one conditional sum per column (which would leave generated code).
WIDE_LIMIT = 64

IS_TARGET = "__target"
_TAG = "\x1f"


@dataclass(frozen=True)
class EventSource:
    """One event table that is rolled up into the panel.

    ``one_hot`` and ``labels`` name the columns counted per value; ``values``
    may fix their value lists, otherwise they are read from the data. ``sums``
    are added up as ``sum_type`` and named ``<source>__<column>``. The default
    keeps nine decimals and twenty digits before them and adds exactly, so the
    order of rows does not matter; what cannot be read as that type counts as
    missing.
    ``target`` marks target events: they make the label and are not counted.
    ``cutoff`` keeps only events up to the first target date.
    """

    name: str
    events: DataFrame
    date: str
    one_hot: Sequence[str] = ()
    labels: Sequence[str] = ()
    sums: Sequence[str] = ()
    target: Column | None = None
    cutoff: bool = True
    separator: str = LABEL_SEPARATOR
    sum_type: str = "decimal(29,9)"
    values: Mapping[str, Sequence] = field(default_factory=dict)

    def rows(self, keys: Sequence[str]) -> DataFrame:
        """Only the needed columns; events without a date or a key are dropped."""
        needed = dict.fromkeys([*keys, *self.one_hot, *self.labels, *self.sums])
        flag = [] if self.target is None else [F.coalesce(self.target, F.lit(False)).alias(IS_TARGET)]
        return self.events.select(
            quoted(self.date).alias("event_date"), *[quoted(c) for c in needed], *flag
        ).na.drop(how="any", subset=["event_date", *keys])


# ---------------------------------------------------------------- periods and spine


def add_period(df: DataFrame, date: str, period: str = "year") -> DataFrame:
    """Add ``period``, the last day of the date's period; rows without a date are dropped."""
    return df.where(quoted(date).isNotNull()).withColumn("period", period_end(quoted(date), period))


def period_bounds(frames: Mapping[str, tuple[DataFrame, str]], period: str) -> dict:
    """First and last period per table, in one job that returns one row per table.

    Only the extreme dates are looked up; Parquet can answer from its footers
    when aggregate push-down is on.
    """
    parts = [
        df.agg(F.min(quoted(date)).alias("lo"), F.max(quoted(date)).alias("hi")).select(
            F.lit(name).alias("name"), period_end("lo", period).alias("lo"), period_end("hi", period).alias("hi")
        )
        for name, (df, date) in frames.items()
    ]
    rows = reduce(DataFrame.unionByName, parts).collect()
    return {row["name"]: (row["lo"], row["hi"]) for row in rows if row["lo"] is not None}


def merge_bounds(bounds: Sequence[tuple]) -> list[tuple]:
    """Join overlapping ranges so that each period appears once."""
    merged: list[tuple] = []
    for low, high in sorted(bounds):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def spine(areas: DataFrame, bounds: Sequence[tuple], period: str, keys: Sequence[str]) -> DataFrame:
    """Every area in every period of the given ranges, generated per area without a join."""
    ranges = [period_range(F.lit(low), F.lit(high), period) for low, high in bounds]
    ranges = ranges or [F.array().cast("array<date>")]
    periods = ranges[0] if len(ranges) == 1 else F.array_distinct(F.concat(*ranges))
    return areas.select(*keys).distinct().select(F.explode(periods).alias("period"), *keys)


def period_values(bounds: Sequence[tuple], period: str) -> set:
    """The period ends of the given ranges, as dates (a few thousand at most)."""
    ends = set()
    for low, high in bounds:
        day = low
        while day <= high:
            ends.add(day)
            day = next_period_end(day, period)
    return ends


# ---------------------------------------------------------------- label and first target date


def first_target_dates(
    events: DataFrame, date: str, flag: Column, keys: Sequence[str], period: str = "year"
) -> DataFrame:
    """Earliest target date per (period, area)."""
    rows = events.where(flag).na.drop(how="any", subset=list(keys))
    return add_period(rows, date, period).groupBy("period", *keys).agg(
        F.min(quoted(date)).alias("first_date")
    )


def label_counts(
    events: DataFrame, date: str, flag: Column, keys: Sequence[str], period: str = "year"
) -> DataFrame:
    """Per (period, area): whether a target happened and when first, in one aggregate."""
    rows = add_period(events.na.drop(how="any", subset=list(keys)), date, period)
    return label_of(rows, date, flag, keys)


def label_of(rows: DataFrame, date: str, flag: Column, keys: Sequence[str]) -> DataFrame:
    """Label and first target date from rows that already have their period."""
    return rows.groupBy("period", *keys).agg(
        F.max(F.when(flag, 1).otherwise(0)).cast("bigint").alias("target"),
        F.min(F.when(flag, quoted(date))).alias("first_date"),
    )


# ---------------------------------------------------------------- counting one source


def read_categories(
    sources: Sequence[EventSource], keys: Sequence[str], limit: int = MAX_CATEGORIES
) -> dict[tuple[str, str], list]:
    """Sorted value lists of all one-hot and label columns, read in one job."""
    return survey({s.name: (s, s.rows(keys)) for s in sources}, False, limit)[0]


def survey(
    tables: Mapping[str, tuple[EventSource, DataFrame]], with_bounds: bool = True, limit: int | None = MAX_CATEGORIES
) -> tuple[dict[tuple[str, str], list], dict[str, tuple]]:
    """(value lists, period bounds) of several sources in one job.

    The value lists are those of the one-hot and label columns; target events
    do not contribute. A column with more than ``limit`` values raises; lists
    are never cut. ``with_bounds`` adds the first and last period of rows that
    carry a ``period``.
    """
    lists: dict[tuple[str, str], list] = {}
    bounds: dict[str, tuple] = {}
    parts = []
    no_date = F.lit(None).cast("date")
    for source, rows in tables.values():
        if with_bounds:
            extremes = rows.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
            parts.append(
                extremes.select(
                    F.lit(source.name).alias("source"),
                    F.lit(None).cast("string").alias("column"),
                    F.lit(None).cast("string").alias("value"),
                    "lo",
                    "hi",
                )
            )
        if source.target is not None:
            rows = rows.where(~F.col(IS_TARGET))
        for column in [*source.one_hot, *source.labels]:
            if column in source.values:
                lists[source.name, column] = list(source.values[column])
                continue
            lists[source.name, column] = []
            values = rows.select(quoted(column).cast("string").alias("value")).na.drop().distinct()
            if column in source.labels:
                values = values.select(
                    F.explode(split_labels("value", source.separator)).alias("value")
                ).distinct()
            parts.append(
                (values if limit is None else values.limit(limit + 1)).select(
                    F.lit(source.name).alias("source"),
                    F.lit(column).alias("column"),
                    "value",
                    no_date.alias("lo"),
                    no_date.alias("hi"),
                )
            )
    for row in reduce(DataFrame.unionByName, parts).collect() if parts else []:
        if row["column"] is not None:
            lists[row["source"], row["column"]].append(row["value"])
        elif row["lo"] is not None:
            bounds[row["source"]] = (row["lo"], row["hi"])
    for (source, column), values in lists.items():
        lists[source, column] = sorted_categories([(v,) for v in values], limit, f"{source}.{column}")
    return lists, bounds


def before_first_target(daily: DataFrame, first: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep events up to the first target date of their (period, area), that day included.

    Without a target the whole period is kept up to its last day at midnight.
    """
    cutoffs = first.where(F.col("first_date").isNotNull()).select(
        "period", *keys, F.col("first_date").alias("__first")
    )
    joined = daily.join(cutoffs, ["period", *keys], "left")
    last = F.coalesce(F.col("__first"), F.col("period").cast(dict(first.dtypes)["first_date"]))
    return joined.where(F.col("event_date") <= last).drop("__first")


def source_daily(
    source: EventSource, keys: Sequence[str], period: str, by_day: bool = True
) -> DataFrame:
    """Pre-count a source per (period, area, date, values) before anything is joined.

    This bounds what a hot area can send to one task by its dates and value
    combinations, whatever its number of events. ``by_day`` raises a time of
    day to the next midnight: against a cutoff at midnight that changes no
    comparison, and it keeps the number of dates small. It must be off where
    the target times have a time of day.
    """
    values = [*source.one_hot, *source.labels] + ([] if source.target is None else [IS_TARGET])
    rows = add_period(source.rows(keys), "event_date", period)
    if by_day and not _is_date(source):
        day = F.col("event_date").cast("date")
        later = F.col("event_date").cast("timestamp_ntz") > day.cast("timestamp_ntz")
        rows = rows.withColumn("event_date", F.date_add(day, F.when(later, 1).otherwise(0)))
    group = dict.fromkeys(["period", *keys, "event_date", *values])
    return rows.groupBy(*[quoted(c) for c in group]).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(quoted(c).try_cast(source.sum_type)).alias(c) for c in source.sums],
    )


def _is_date(source: EventSource) -> bool:
    return dict(source.events.dtypes)[source.date] == "date"


def _value_columns(source: EventSource, lists: Mapping[tuple[str, str], list]) -> list[tuple[str, str, object]]:
    """(column, output name, value) for every counted value of a source, names unique."""
    pairs = [
        (column, value)
        for column in [*source.one_hot, *source.labels]
        for value in lists[source.name, column]
    ]
    # A value found in two columns of one source (a result that is also a label) gets a number.
    taken: dict[str, int] = {}
    named = []
    for column, value in pairs:
        name = feature_names(source.name, [value])[value]
        taken[name.lower()] = taken.get(name.lower(), 0) + 1
        repeat = taken[name.lower()]
        named.append((column, name if repeat == 1 else f"{name}_{repeat}", value))
    return named


def sum_names(source: EventSource) -> list[str]:
    """Output names of a source's sums."""
    return [feature_name(source.name, c) for c in source.sums]


def value_text(value) -> str:
    """A listed value as Spark writes it when it casts a column to text."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def count_wide(
    daily: DataFrame, source: EventSource, keys: Sequence[str], lists: Mapping[tuple[str, str], list]
) -> DataFrame:
    """One row per (period, area) with a count per value and the sums of the source."""
    named = _value_columns(source, lists)
    sums = [F.sum(quoted(c)).cast("double").alias(name) for c, name in zip(source.sums, sum_names(source))]
    if len(named) > WIDE_LIMIT:
        return _count_by_pivot(daily, source, keys, named, sums)
    for column in source.labels:
        daily = daily.withColumn(column, split_labels(quoted(column), source.separator))

    def hit(column: str, value) -> Column:
        if column in source.labels:
            return F.array_contains(quoted(column), F.lit(value))
        return quoted(column).cast("string") == F.lit(value_text(value))

    counts = [
        F.sum(F.when(hit(column, value), F.col("__n")).otherwise(0)).cast("bigint").alias(name)
        for column, name, value in named
    ]
    extra = [] if counts or sums else [F.sum("__n").cast("bigint").alias(f"{source.name}__all")]
    return daily.groupBy("period", *keys).agg(*counts, *sums, *extra)


def _count_by_pivot(daily, source, keys, named, sums) -> DataFrame:
    """Many values: count in long form first, then pivot the few counted rows."""

    def tagged(column: str) -> Column:
        """Array of ``column<separator>value`` tags of one counted column."""
        if column in source.labels:
            values = F.coalesce(split_labels(quoted(column), source.separator), F.array().cast("array<string>"))
        else:
            values = F.array_compact(F.array(quoted(column).cast("string")))
        return F.transform(values, lambda value: F.concat(F.lit(column + _TAG), value))

    tags = F.concat(*[tagged(c) for c in [*source.one_hot, *source.labels]])
    names = {column + _TAG + value_text(value): name for column, name, value in named}
    pivoted = (
        daily.select("period", *keys, F.explode(tags).alias("__tag"), "__n")
        .groupBy("period", *keys)
        .pivot("__tag", list(names))
        .agg(F.sum("__n").cast("bigint"))
        .toDF("period", *keys, *names.values())
    )
    # Groups whose values are all missing have no long rows, so the keys come from the daily rows.
    base = daily.groupBy("period", *keys).agg(*(sums or [F.sum("__n").alias("__all")]))
    return fill_zero(
        base.join(pivoted, ["period", *keys], "left").select(
            "period", *keys, *names.values(), *[quoted(c) for c in sum_names(source)]
        ),
        list(names.values()),
    )


def source_counts(
    source: EventSource,
    keys: Sequence[str],
    period: str,
    lists: Mapping[tuple[str, str], list],
    first: DataFrame | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Wide counts of one source, from its ``daily`` rows where they already exist."""
    if daily is None:
        by_day = first is None or dict(first.dtypes)["first_date"] == "date"
        daily = source_daily(source, keys, period, by_day)
    if source.target is not None:
        daily = daily.where(~F.col(IS_TARGET)).drop(IS_TARGET)
    if source.cutoff:
        if first is None:
            raise ValueError(f"source {source.name!r} needs first target dates")
        daily = before_first_target(daily, first, keys)
    return count_wide(daily, source, keys, lists)


def long_counts(
    source: EventSource,
    keys: Sequence[str],
    period: str = "year",
    first: DataFrame | None = None,
) -> DataFrame:
    """Rows (period, keys, column, value, n): counts of any number of values, without a value list.

    The same events count as in ``source_panel``; absent values have no row.
    """
    keys = list(keys)
    by_day = _is_date(source) if source.target is not None else (first is None or dict(first.dtypes)["first_date"] == "date")
    daily = source_daily(source, keys, period, by_day)
    if source.target is not None:
        with sized_shuffles(source.events):
            daily = cut_lineage(daily)
        first = label_of(daily, "event_date", F.col(IS_TARGET), keys)
        daily = daily.where(~F.col(IS_TARGET)).drop(IS_TARGET)
    if source.cutoff:
        if first is None:
            raise ValueError(f"source {source.name!r} needs first target dates")
        daily = before_first_target(daily, first, keys)

    def pairs(column: str) -> Column:
        if column in source.labels:
            values = F.coalesce(split_labels(quoted(column), source.separator), F.array().cast("array<string>"))
        else:
            values = F.array_compact(F.array(quoted(column).cast("string")))
        return F.transform(values, lambda v: F.struct(F.lit(column).alias("column"), v.alias("value")))

    rows = daily.select("period", *keys, "__n", F.explode(F.concat(*[pairs(c) for c in [*source.one_hot, *source.labels]])).alias("pair"))
    return rows.groupBy("period", *keys, F.col("pair.column").alias("column"), F.col("pair.value").alias("value")).agg(
        F.sum("__n").cast("bigint").alias("n")
    )


def value_index(counts: DataFrame) -> DataFrame:
    """Rows (column, value, index) of ``long_counts``: places 0, 1, ... of the values in sorted order.

    Values are range-partitioned; places come from a count per partition and
    one within it, so no task sees all values.
    """
    ranged = counts.select("column", "value").distinct().repartitionByRange("column", "value")
    ranged = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy("column", "value"))
    placed = ranged.withColumn("__within", within).join(sizes, "__part")
    return placed.select("column", "value", (F.col("__before") + F.col("__within") - 1).cast("bigint").alias("index"))


def sparse_counts(counts: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (period, keys, indices, counts): one sparse vector per (period, area), indices ascending."""
    pairs = F.sort_array(F.collect_list(F.struct("index", "n")))
    rows = counts.join(index, ["column", "value"]).groupBy("period", *keys).agg(pairs.alias("__pairs"))
    return rows.select("period", *keys, F.col("__pairs.index").alias("indices"), F.col("__pairs.n").alias("counts"))


def densify(counts: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known areas only, every period of the spine, zeros where nothing happened."""
    return fill_zero(
        universe.join(counts, ["period", *keys], "left"),
        [c for c in counts.columns if c not in ("period", *keys) and dict(counts.dtypes)[c] != "date"],
    )


def source_panel(
    source: EventSource,
    areas: DataFrame,
    keys: Sequence[str],
    period: str = "year",
    first: DataFrame | None = None,
    max_categories: int | None = MAX_CATEGORIES,
) -> DataFrame:
    """Dense counts of one source over its own periods, from one pass over its events.

    A source with a ``target`` is cut off at its own first target dates, any
    other one at those in ``first``.
    """
    keys = list(keys)
    by_day = _is_date(source) if source.target is not None else (
        first is None or dict(first.dtypes)["first_date"] == "date"
    )
    with sized_shuffles(source.events):
        daily = cut_lineage(source_daily(source, keys, period, by_day))
    lists, bounds = survey({source.name: (source, daily)}, limit=max_categories)
    if source.target is not None:
        first = label_of(daily, "event_date", F.col(IS_TARGET), keys)
    counts = source_counts(source, keys, period, lists, first, daily)
    return densify(counts, spine(areas.na.drop(), list(bounds.values()), period, keys), keys)


# ---------------------------------------------------------------- the whole panel


@dataclass(frozen=True)
class PanelResult:
    """The panel with the bookkeeping needed to explain it."""

    panel: DataFrame
    features: list[str]
    dropped: list[str]
    frame_rows: int


def outer_frame_rows(areas: int, base: set, others: Sequence[set]) -> int:
    """Rows of the full outer frame of target, counted events and the further sources.

    Periods of a further source that the base does not have stay rows of their
    own, per source, because its date is not merged into the base date.
    """
    return areas * (len(base) + sum(len(periods - base) for periods in others))


def build_panel(
    areas: DataFrame,
    sources: Sequence[EventSource],
    keys: Sequence[str],
    period: str = "year",
    min_ratio: float | None = None,
    attributes: DataFrame | None = None,
    until: str | None = None,
    keep_unmatched_periods: bool = False,
    max_categories: int | None = MAX_CATEGORIES,
) -> PanelResult:
    """Label, counted sources and static attributes per (period, area).

    The one source with a ``target`` gives the label, the cutoff dates and the
    periods of the panel; the others are attached to it. ``min_ratio`` drops
    count columns whose sum over the full outer frame is below that share of
    its rows. ``keep_unmatched_periods`` also keeps periods found only in
    another source. ``max_categories`` guards against an accidental flood of
    columns and may be None; ``long_counts`` has no column per value at all.

    Each source is read once: its reduced rows are written to the checkpoint
    folder, and everything after works on those.
    """
    keys = list(keys)
    base = [s for s in sources if s.target is not None]
    if len(base) != 1:
        raise ValueError("exactly one source must have a target")
    base = base[0]
    areas = areas.select(*keys).na.drop().distinct()
    by_day = _is_date(base)
    with sized_shuffles(*[s.events for s in sources]):
        daily = _write_all({s.name: source_daily(s, keys, period, by_day) for s in sources})
    lists, bounds = survey({s.name: (s, daily[s.name]) for s in sources}, limit=max_categories)
    span = [bounds[base.name]] if base.name in bounds else []
    further = [s for s in sources if s is not base and s.name in bounds]

    # One row per (period, area) with events; every cutoff and the panel itself read it.
    label = cut_lineage(label_of(daily[base.name], "event_date", F.col(IS_TARGET), keys))
    counts = {s.name: source_counts(s, keys, period, lists, label, daily[s.name]) for s in sources}

    keep = None
    dropped: list[str] = []
    frame_rows = 0
    if min_ratio is not None:
        # The column decision and the panel both read the counts: write them once.
        counts = _write_all({n: df.join(areas, keys, "left_semi") for n, df in counts.items()})
        base_periods = period_values(span, period)
        other_periods = [period_values([bounds[s.name]], period) for s in further]
        frame_rows = outer_frame_rows(areas.count(), base_periods, other_periods)
        sums = column_sums(counts, keys)
        keep = set(frequent_columns(sums, frame_rows, min_ratio))
        dropped = [c for c in sums if c not in keep]

    if keep_unmatched_periods:
        span = merge_bounds([*span, *[bounds[s.name] for s in further]])
    panel = spine(areas, span, period, keys)
    if until is not None:
        panel = panel.where(F.col("period") <= F.lit(until).cast("date"))
    panel = panel.join(label.drop("first_date"), ["period", *keys], "left")
    features: list[str] = []
    for source in sources:
        df = counts[source.name]
        names = [c for c in df.columns if c not in ("period", *keys) and (keep is None or c in keep)]
        if names:
            panel = panel.join(
                df.select("period", *keys, *[quoted(c) for c in names]), ["period", *keys], "left"
            )
            features += names
    if attributes is not None:
        panel = static_attributes(panel, attributes, keys)
        features += [c for c in attributes.columns if c not in keys]
    return PanelResult(fill_zero(panel, ["target", *numeric_only(panel, features)]), features, dropped, frame_rows)


def _write_all(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Cut the lineage of several independent tables at the same time."""
    return dict(zip(frames, run_parallel(cut_lineage, list(frames.values()), len(frames))))


def numeric_only(df: DataFrame, names: Sequence[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [n for n in names if kinds[n] not in ("string", "date", "boolean")]


def column_sums(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> dict[str, float]:
    """Sum of every count column over all tables, in one job that returns one row per table."""
    parts = []
    for df in frames.values():
        names = [c for c in df.columns if c not in ("period", *keys)]
        pairs = F.array(
            *[
                F.struct(F.lit(c).alias("name"), F.coalesce(F.sum(quoted(c)).cast("double"), F.lit(0.0)).alias("total"))
                for c in names
            ]
        )
        parts.append(df.agg(pairs.alias("sums")))
    rows = reduce(DataFrame.unionByName, parts).collect()
    return {pair["name"]: pair["total"] for row in rows for pair in row["sums"]}

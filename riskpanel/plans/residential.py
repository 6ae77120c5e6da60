"""The domain panel: from the landed sources to one row per (year, area)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import target_flag
from ..operators.columns import MAX_CATEGORIES, categories_of, drop_columns, one_hot, quoted
from ..operators.panel import EventSource, PanelResult, build_panel
from ..session import cut_lineage, cut_to_table, sized_shuffles
from ..sources import readers, schemas
from . import cleaning

# Smallest share of the rows a column sum must reach, and the last day of the panel.
MIN_COLUMN_RATIO = 0.0001
PANEL_END = "2017-12-31"
TRAIN_END = "2016-12-31"
VALIDATION_END = "2015-12-31"
# Distinct date texts of a source up to this many are read once and broadcast; more are read row by row.
MAX_DATE_TEXTS = 500_000


@dataclass(frozen=True)
class Place:
    """How the sources spell the place of interest."""

    city: str
    municipality: str
    subdivision: str


@dataclass(frozen=True)
class Sources:
    inspections: DataFrame
    assessments: DataFrame
    liens: DataFrame
    parcels: DataFrame
    census: Sequence[DataFrame]
    incidents_old: DataFrame
    incidents_new: DataFrame


def read_sources(
    spark: SparkSession, folder: str, files: Mapping | None = None, multi_line: bool = False
) -> Sources:
    """All landed files of one folder; ``files`` overrides names in ``schemas.FILES``.

    ``multi_line`` reads quoted line breaks; files with two header lines then take one task each.
    """
    folder = folder.rstrip("/")
    names = {**schemas.FILES, **(files or {})}

    def csv(key: str, schema, encoding: str = "UTF-8") -> DataFrame:
        return readers.read_csv(spark, f"{folder}/{names[key]}", schema, encoding, multi_line=multi_line)

    return Sources(
        inspections=csv("inspections", schemas.INSPECTIONS),
        assessments=csv("assessments", schemas.ASSESSMENTS, "ISO-8859-1"),
        liens=csv("liens", schemas.LIENS),
        parcels=csv("parcels", schemas.PARCELS),
        census=[readers.read_two_line_csv(spark, f"{folder}/{name}", multi_line=multi_line) for name in names["census"]],
        incidents_old=csv("incidents_old", None, "ISO-8859-1"),
        incidents_new=csv("incidents_new", None),
    )


@dataclass(frozen=True)
class Prepared:
    incidents: DataFrame
    inspections: DataFrame
    liens: DataFrame
    profile: DataFrame
    areas: DataFrame
    rejects: Mapping[str, int]


def prepare(
    sources: Sources,
    place: Place,
    rare_count: int = cleaning.RARE_CODE_COUNT,
    min_values: int | None = cleaning.PROPERTY_MIN_VALUES,
    fix_street_type: bool = False,
    keep: Sequence[str] = ("CALL_CREATED_DATE", "code"),
    min_fraction: float | None = None,
    bad_dates: str = "raise",
) -> Prepared:
    """Clean every source and attach areas.

    ``keep`` and ``min_fraction`` are the kept incident columns and the share of
    values each must have. Texts that are no date raise, with their number per
    source; with ``bad_dates="drop"`` they are only counted, in ``rejects``.
    """
    if bad_dates not in ("raise", "drop"):
        raise ValueError("bad_dates is 'raise' or 'drop'")
    columns = cleaning.date_columns(
        sources.inspections, sources.liens, [sources.incidents_old, sources.incidents_new]
    )
    # A date text is read once, however many rows have it.
    with sized_shuffles(*[table for table, _ in columns.values()]):
        texts = cut_to_table(cleaning.moments_of(columns))
    rejects = {**dict.fromkeys(columns, 0), **cleaning.rejects_of(texts)}
    sizes = {row["source"]: row["count"] for row in texts.groupBy("source").count().collect()}

    def moments(name: str) -> DataFrame | None:
        """The moments of a source's texts, if they are few enough to be sent to every task."""
        if sizes.get(name, 0) > MAX_DATE_TEXTS:
            return None
        return texts.where(F.col("source") == name)

    if bad_dates == "raise" and any(rejects.values()):
        raise ValueError(f"texts that are no date: {rejects}; pass bad_dates='drop' to go on without them")
    properties, lookup = cleaning.clean_properties(sources.assessments, place.city, min_values)
    # Read by every source below: written once.
    lookup = cut_to_table(lookup)
    parcels = cut_to_table(cleaning.parcel_areas(sources.parcels, place.subdivision))
    census = cleaning.combine_census([cleaning.clean_census(t) for t in sources.census])
    profile, _ = cleaning.area_profile(properties, parcels, census)
    # One row per area; read for the area list, the categories and the final join.
    profile = cut_lineage(profile)
    inspections = cleaning.clean_inspections(sources.inspections, lookup, moments("inspections"))
    liens = cleaning.clean_liens(sources.liens, lookup, place.municipality, moments("liens"))
    incidents = cleaning.clean_incidents(
        sources.incidents_old, sources.incidents_new, rare_count, fix_street_type, moments("incidents")
    )
    return Prepared(
        incidents=cleaning.incidents_to_areas(incidents, lookup, parcels, keep, min_fraction),
        inspections=cleaning.events_to_areas(inspections, parcels, "PARCEL"),
        liens=cleaning.events_to_areas(liens, parcels, "pin"),
        profile=profile,
        areas=profile.select(*cleaning.KEYS).distinct(),
        rejects=rejects,
    )


def encode_profile(
    profile: DataFrame, columns: Sequence[str] = cleaning.PROFILE_MODES, max_categories: int | None = MAX_CATEGORIES
) -> DataFrame:
    """One-hot the profile's categories while it has one row per area."""
    for column, values in categories_of(profile, columns, max_categories).items():
        profile = one_hot(profile, column, values)
    return drop_columns(profile, columns)


def residential_panel(
    prepared: Prepared,
    period: str = "year",
    min_ratio: float | None = MIN_COLUMN_RATIO,
    until: str | None = PANEL_END,
    liens_cutoff: bool = False,
    keep_unmatched_periods: bool = False,
    lien_sums: Sequence[str] = ("amount",),
    values: Mapping[str, Mapping[str, Sequence]] | None = None,
    max_categories: int | None = MAX_CATEGORIES,
) -> PanelResult:
    """Label, counts before the first target, liens of the year and the encoded profile.

    ``lien_sums`` may also name ``satisfied`` where that column is numeric.
    ``max_categories`` is the most values a one-hot column may have, None for no limit.
    """
    values = values or {}
    sources = [
        EventSource(
            "incident",
            prepared.incidents,
            "CALL_CREATED_DATE",
            one_hot=["code"],
            target=target_flag("code", cleaning.TARGET_PREFIX) == 1,
            values=values.get("incident", {}),
        ),
        EventSource(
            "inspection",
            prepared.inspections,
            "INSPECTION_DATE",
            one_hot=["INSPECTION_RESULT"],
            labels=["VIOLATION"],
            values=values.get("inspection", {}),
        ),
        EventSource(
            "lien",
            prepared.liens,
            "tax_year",
            one_hot=["lien_description"],
            sums=lien_sums,
            cutoff=liens_cutoff,
            values=values.get("lien", {}),
        ),
    ]
    return build_panel(
        prepared.areas,
        sources,
        cleaning.KEYS,
        period=period,
        min_ratio=min_ratio,
        attributes=encode_profile(prepared.profile, max_categories=max_categories),
        until=until,
        keep_unmatched_periods=keep_unmatched_periods,
        max_categories=max_categories,
    )


def feature_columns(result: PanelResult) -> list[str]:
    kinds = dict(result.panel.dtypes)
    return [c for c in result.features if kinds[c] not in ("string", "date")]


def training_matrix(result: PanelResult, until: str = TRAIN_END) -> DataFrame:
    """Rows of the training years, ready for a sink."""
    return result.panel.where(quoted("period") <= F.lit(until).cast("date"))

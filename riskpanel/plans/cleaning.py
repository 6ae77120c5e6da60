"""Cleaning plans for the domain sources: census, properties, inspections, liens, parcels, incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import parse_timestamp, year_end
from ..functions.numbers import scaled_key
from ..functions.text import (
    GEOGRAPHY_PATTERN,
    clean_street,
    extract_groups,
    first_char,
    first_part,
    join_strict,
    normalise_code,
    normalise_street_type,
    strip,
)
from ..operators.aggregate import group_profile, union_all_names
from ..operators.columns import (
    drop_columns,
    drop_positions,
    drop_prefixed,
    drop_sparse,
    promote_header,
    quoted,
    rename_position,
)
from ..operators.filters import differs, drop_null_rows, drop_rare, not_matching
from ..operators.joins import equi_join, left_lookup, outer_join_all, semi_join

KEYS = ("tract", "block")

# Markers in the data.
CENSUS_HEADER = "Id"
CENSUS_TOTALS = (0, 1)
CENSUS_ERRORS = "Margin"
RESIDENTIAL = "RESIDENTIAL"
BAD_HOUSE_NUMBER = "0"
BAD_ADDRESS = ""
BAD_PINS = (" ", "COMMON GROUND")
BAD_PIN_PATTERN = ".*County"
EXCLUDED_CODES = (
    "540 - Animal problem, Other",
    "5532 - Public Education (Station Visit)",
    "353 - Removal of victim(s) from stalled elevator",
)
TARGET_PREFIX = "1"
RARE_CODE_COUNT = 20
PROPERTY_MIN_VALUES = 4000
INCIDENT_MIN_FRACTION = 0.15
PROPERTY_COLUMNS = (
    "PARID", "PROPERTYHOUSENUM", "PROPERTYADDRESS", "MUNIDESC", "SCHOOLDESC", "NEIGHCODE", "TAXDESC",
    "OWNERDESC", "USEDESC", "LOTAREA", "SALEPRICE", "FAIRMARKETBUILDING", "FAIRMARKETLAND",
)
PROFILE_MODES = ("MUNIDESC", "SCHOOLDESC", "NEIGHCODE", "TAXDESC", "OWNERDESC", "USEDESC")
PROFILE_MEANS = ("LOTAREA", "SALEPRICE", "FAIRMARKETBUILDING", "FAIRMARKETLAND")
OLD_INCIDENT_DROPS = (
    "Unnamed: 0", "PRIMARY_UNIT", "MAP_PAGE", "alm_dttm", "arv_dttm", "XCOORD", "YCOORD", "inci_id",
    "inci_type", "alarms", "st_prefix", "st_suffix", "st_type", "CALL_NO", "descript", "AGENCY",
)
NEW_INCIDENT_DROPS = (
    "alm_dttm", "arv_dttm", "XCOORD", "YCOORD", "alarms", "inci_type", "CALL_NO", "descript",
)


def clean_census(raw: DataFrame) -> DataFrame:
    """One census table: real names from its second header line, area keys, estimates as numbers.

    Totals and error margins are dropped. Names lose dots and semicolons,
    which Spark would read as struct access.
    """
    named = promote_header(raw, CENSUS_HEADER)
    named = named.toDF(*[c.replace(".", "_").replace(";", "").strip() for c in named.columns])
    block, tract = extract_groups("Geography", GEOGRAPHY_PATTERN, 2)
    keyed = named.select(
        scaled_key(tract).alias("tract"),
        block.cast("bigint").alias("block"),
        *[quoted(c) for c in named.columns],
    )
    values = drop_columns(keyed, ["Id", "Id2", "Geography"])
    values = drop_positions(values, [len(KEYS) + p for p in CENSUS_TOTALS])
    values = drop_prefixed(values, CENSUS_ERRORS)
    return values.select(
        *KEYS, *[quoted(c).try_cast("double").alias(c) for c in values.columns if c not in KEYS]
    )


def combine_census(tables: Sequence[DataFrame]) -> DataFrame:
    """All census attributes per area. Rows without a key name no area and would only multiply; they are left out.

    An attribute name found in several tables gets the suffixes ``_x`` and ``_y``.
    """
    return outer_join_all([t.na.drop(subset=list(KEYS)) for t in tables], KEYS)


def clean_properties(
    assessments: DataFrame, city: str, min_values: int | None = PROPERTY_MIN_VALUES
) -> tuple[DataFrame, DataFrame]:
    """(properties, address lookup) of the residential properties of a city.

    The lookup is taken before house numbers are filtered. Columns with too
    few values vanish; asking for one of them afterwards is an error.
    """
    homes = assessments.where((F.col("PROPERTYCITY") == city) & (F.col("CLASSDESC") == RESIDENTIAL))
    lookup = homes.select("PARID", "PROPERTYADDRESS", "PROPERTYHOUSENUM").distinct()
    homes = homes.where(
        differs("PROPERTYHOUSENUM", BAD_HOUSE_NUMBER) & differs("PROPERTYADDRESS", BAD_ADDRESS)
    )
    if min_values is not None:
        homes = drop_sparse(homes, min_count=min_values)
    return rename_position(homes, 0, "PARID").select(*PROPERTY_COLUMNS).distinct(), lookup


def moments_of(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows (source, text, n, moment): every distinct date text of a (table, column) per source, read once, with its number of rows."""
    counted = [
        table.where(quoted(column).isNotNull())
        .groupBy(quoted(column).cast("string").alias("text"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("source"), "text", "n")
        for name, (table, column) in tables.items()
    ]
    return union_all_names(*counted).withColumn("moment", parse_timestamp("text"))


def read_moments(df: DataFrame, column: str, name: str, moments: DataFrame | None) -> DataFrame:
    """Add the moment of a date text as ``name``: looked up in ``moments`` (text, moment) of all its texts, else read per row."""
    if moments is None:
        return df.withColumn(name, parse_timestamp(column))
    known = F.broadcast(moments.select(F.col("text").alias("__text"), F.col("moment").alias(name)))
    return df.join(known, quoted(column).cast("string") == F.col("__text"), "left").drop("__text")


def clean_inspections(inspections: DataFrame, lookup: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Distinct inspections of residential parcels with parsed dates; unread dates stay apart in ``distinct``."""
    inspections = inspections.withColumns(
        {"STREET_NAME": strip("STREET_NAME"), "STREET_NUM": strip("STREET_NUM")}
    )
    found = read_moments(semi_join(inspections, lookup, {"PARCEL": "PARID"}), "INSPECTION_DATE", "__moment", moments)
    return (
        found.select(
            "PARCEL",
            F.col("__moment").alias("INSPECTION_DATE"),
            "INSPECTION_RESULT",
            "VIOLATION",
            F.col("INSPECTION_DATE").alias("__raw"),
        )
        .withColumn("__raw", F.when(F.col("INSPECTION_DATE").isNull(), F.col("__raw")))
        .withColumn("violation_year", F.year("INSPECTION_DATE"))
        .distinct()
        .drop("__raw")
    )


def clean_liens(liens: DataFrame, lookup: DataFrame, municipality: str, moments: DataFrame | None = None) -> DataFrame:
    """Distinct complete liens of residential parcels; the tax year becomes its last day.

    Liens whose filing dates cannot be read are told apart by the raw text.
    """
    required = ["pin", "tax_year", "lien_description", "amount", "satisfied"]
    rows = drop_null_rows(liens.where(F.col("municipality") == municipality), required)
    return (
        read_moments(semi_join(rows, lookup, {"pin": "PARID"}), "filing_date", "__moment", moments)
        .select(
            "pin",
            F.col("__moment").cast("date").alias("filing_date"),
            year_end("tax_year").alias("tax_year"),
            "lien_description",
            "amount",
            "satisfied",
            F.col("filing_date").alias("__raw"),
        )
        .withColumn("__raw", F.when(F.col("filing_date").isNull(), F.col("__raw")))
        .distinct()
        .drop("__raw")
    )


def parcel_areas(parcels: DataFrame, subdivision: str) -> DataFrame:
    """Parcel to (tract, block group): the block group is the first digit of the census block."""
    rows = parcels.where(F.col("geo_name_cousub") == subdivision).select(
        "PIN",
        F.col("TRACTCE10").cast("bigint").alias("tract"),
        first_char(F.col("BLOCKCE10").cast("string")).try_cast("bigint").alias("block"),
    )
    return not_matching(rows.where(differs("PIN", *BAD_PINS)), "PIN", BAD_PIN_PATTERN).distinct()


def area_profile(
    properties: DataFrame, parcels: DataFrame, census: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(profile, areas): modes and means per area joined with census attributes, and the area list."""
    placed = left_lookup(properties, parcels, {"PARID": "PIN"})
    profile = group_profile(placed, KEYS, PROFILE_MODES, PROFILE_MEANS, exact_scale=9)
    joined = profile.join(census, list(KEYS), "inner")
    return joined, joined.select(*KEYS).distinct()


def events_to_areas(events: DataFrame, parcels: DataFrame, key: str) -> DataFrame:
    """Attach (tract, block) by parcel; events without an area are dropped."""
    return drop_null_rows(left_lookup(events, parcels, {key: "PIN"}), KEYS).drop(key)


def clean_incidents(
    old: DataFrame,
    new: DataFrame,
    rare_count: int = RARE_CODE_COUNT,
    fix_street_type: bool = False,
    moments: DataFrame | None = None,
) -> DataFrame:
    """Both incident files as one table with cleaned code, street, number and day."""
    old = old.withColumns(
        {
            "full.code": normalise_code(quoted("full.code")),
            "number": strip("number"),
            "street": join_strict(
                " ", strip("street"), strip(normalise_street_type(strip("st_type"), fix_street_type))
            ),
        }
    )
    old = drop_columns(old, [c for c in OLD_INCIDENT_DROPS if c in old.columns])
    new = drop_columns(new, [c for c in NEW_INCIDENT_DROPS if c in new.columns])
    rows = union_all_names(new, old).withColumnRenamed("full.code", "code")
    rows = rows.where(differs(strip("code"), *EXCLUDED_CODES))
    rows = rows.withColumns({"street": clean_street("street"), "number": strip("number")})
    rows = drop_rare(rows, "code", rare_count, TARGET_PREFIX)
    names = rows.columns
    rows = read_moments(rows, "CALL_CREATED_DATE", "__moment", moments)
    day = F.col("__moment").cast("date")
    rows = rows.select(*[(day if c == "CALL_CREATED_DATE" else quoted(c)).alias(c) for c in names])
    rows = rows.withColumn("incident_year", F.year("CALL_CREATED_DATE"))
    # An intersection keeps its first street, with the blank before the slash.
    rows = rows.withColumn("street", first_part("street", "/"))
    return drop_null_rows(rows, ["CALL_CREATED_DATE"]).distinct()


def incidents_to_areas(
    incidents: DataFrame,
    lookup: DataFrame,
    parcels: DataFrame,
    keep: Sequence[str] = ("CALL_CREATED_DATE", "code"),
    min_fraction: float | None = None,
) -> DataFrame:
    """Incidents by address to parcels to areas; distinct rows of the kept columns.

    An address shared by several parcels puts the incident into each of their
    areas. Addresses are brought to distinct areas before any incident meets
    them, so an address of many parcels in one area is one row. ``min_fraction``
    drops kept columns with too few values first; without it, repeated events of
    an address collapse before the join.
    """
    if min_fraction is None:
        incidents = incidents.select(*[quoted(c) for c in keep], "street", "number").distinct()
    parcel_rows = left_lookup(lookup, parcels, {"PARID": "PIN"})
    addresses = drop_null_rows(parcel_rows, KEYS).groupBy("PROPERTYADDRESS", "PROPERTYHOUSENUM", *KEYS).agg(
        F.count(F.lit(1)).alias("__parcels")
    )
    placed = equi_join(
        incidents, addresses, {"street": "PROPERTYADDRESS", "number": "PROPERTYHOUSENUM"}, "inner"
    )
    if min_fraction is not None:
        # The share is of the rows per parcel, which the counts stand for.
        filled = [F.sum(F.when(quoted(c).isNotNull(), F.col("__parcels")).otherwise(0)).alias(c) for c in keep]
        row = placed.agg(F.sum("__parcels").alias("__all"), *filled).first()
        keep = [c for c in keep if (row[c] or 0) >= min_fraction * (row["__all"] or 0)]
    return placed.select(*[quoted(c) for c in keep], *KEYS).distinct()


def date_columns(
    inspections: DataFrame, liens: DataFrame, incidents: Sequence[DataFrame]
) -> dict[str, tuple[DataFrame, str]]:
    """The (table, column) of each source's date texts; both incident files are one source."""
    both = union_all_names(*[table.select("CALL_CREATED_DATE") for table in incidents])
    return {
        "inspections": (inspections, "INSPECTION_DATE"),
        "liens": (liens, "filing_date"),
        "incidents": (both, "CALL_CREATED_DATE"),
    }


def rejects_of(moments: DataFrame) -> dict[str, int]:
    """Rows per source of ``moments_of`` whose text is no date."""
    bad = F.sum(F.when(F.col("moment").isNull(), F.col("n")).otherwise(0)).alias("n")
    return {row["source"]: row["n"] for row in moments.groupBy("source").agg(bad).collect()}


def date_rejects(
    inspections: DataFrame, liens: DataFrame, incidents: Sequence[DataFrame]
) -> dict[str, int]:
    """Texts per source that are there but are no date, from one pass over each date column."""
    columns = date_columns(inspections, liens, incidents)
    return {**dict.fromkeys(columns, 0), **rejects_of(moments_of(columns))}

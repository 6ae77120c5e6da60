"""Explicit schemas: no source is read with type inference; columns without a declared type are text.

The tables and their column names are fixed values given by the data portals.
Text columns stay text until a cleaning plan converts them, so that a bad value
becomes a counted reject and not a failed job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T


def _schema(strings: Sequence[str] = (), doubles: Sequence[str] = (), longs: Sequence[str] = ()) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in strings]
    fields += [T.StructField(n, T.DoubleType()) for n in doubles]
    fields += [T.StructField(n, T.LongType()) for n in longs]
    return T.StructType(fields)


INSPECTIONS = _schema(
    ["STREET_NUM", "STREET_NAME", "PARCEL", "INSPECTION_DATE", "INSPECTION_RESULT", "VIOLATION"]
)
ASSESSMENTS = _schema(
    [
        "PARID", "PROPERTYHOUSENUM", "PROPERTYADDRESS", "PROPERTYCITY", "CLASSDESC", "MUNIDESC",
        "SCHOOLDESC", "NEIGHCODE", "TAXDESC", "OWNERDESC", "USEDESC",
    ],
    ["LOTAREA", "SALEPRICE", "FAIRMARKETBUILDING", "FAIRMARKETLAND"],
)
LIENS = _schema(
    ["pin", "municipality", "filing_date", "lien_description", "satisfied"], ["amount"], ["tax_year"]
)
PARCELS = _schema(["PIN", "BLOCKCE10", "geo_name_cousub"], longs=["TRACTCE10"])
# Names under which the landed files are looked up; a caller may pass its own.
FILES = {
    "inspections": "inspections.csv",
    "assessments": "assessments.csv",
    "liens": "liens.csv",
    "parcels": "parcels.csv",
    "incidents_old": "incidents_old.csv",
    "incidents_new": "incidents_new.csv",
    "census": ("acs_income.csv", "acs_occupancy.csv", "acs_year_built.csv", "acs_year_moved.csv"),
}

"""Seven tiny source files through the whole domain plan to a panel worked out by hand."""

import datetime as dt
import os

import pytest

from riskpanel.operators.panel import EventSource, build_panel
from riskpanel.operators import columns
from riskpanel.plans import cleaning, residential

FILES = {
    "parcels.csv": """PIN,TRACTCE10,BLOCKCE10,geo_name_cousub
P1,10300,1001,Riverton city
P2,10300,1002,Riverton city
P3,20100,2003,Riverton city
" ",20100,2004,Riverton city
COMMON GROUND,20100,2004,Riverton city
Allegro County,20100,2004,Riverton city
P7,30000,1001,Elsewhere
""",
    "assessments.csv": """PARID,PROPERTYHOUSENUM,PROPERTYADDRESS,PROPERTYCITY,CLASSDESC,MUNIDESC,SCHOOLDESC,NEIGHCODE,TAXDESC,OWNERDESC,USEDESC,LOTAREA,SALEPRICE,FAIRMARKETBUILDING,FAIRMARKETLAND,EMPTY
P1,12,MAIN ST,RIVERTON,RESIDENTIAL,W,S,N,T,O,SINGLE,1,100,1,1,
P2,14,MAIN ST,RIVERTON,RESIDENTIAL,W,S,N,T,O,SINGLE,1,,1,1,
P3,7,OAK AVE,RIVERTON,RESIDENTIAL,W,S,N,T,O,TWO,1,50,1,1,
P4,0,OAK AVE,RIVERTON,RESIDENTIAL,W,S,N,T,O,TWO,1,10,1,1,
P5,9,OAK AVE,RIVERTON,COMMERCIAL,W,S,N,T,O,SHOP,1,10,1,1,
P6,9,ELM ST,OTHER,RESIDENTIAL,W,S,N,T,O,SINGLE,1,10,1,1,
P8,,ELM ST,RIVERTON,RESIDENTIAL,W,S,N,T,O,SINGLE,1,10,1,1,
""",
    "incidents_new.csv": """CALL_CREATED_DATE,full.code,number,street,alarms
2014-03-01 10:00:00,111 - Building fire,12,"MAIN ST, PGH",1
2014-02-01 09:00:00,735 - Alarm,14,MAIN ST,1
2014-03-01 23:00:00,735 - Alarm,12,MAIN ST #2,1
2014-05-01 08:00:00,735 - Alarm,12,MAIN ST,1
2015-06-01 08:00:00,735 - Alarm,7,OAK AVE,1
2014-07-01 08:00:00,"540 - Animal problem, Other",12,MAIN ST,1
,735 - Alarm,12,MAIN ST,1
2014-02-01 11:00:00,735 - Alarm,14,MAIN ST,1
2014-02-03 11:00:00,735 - Alarm,12,MAIN ST / OAK AVE,1
""",
    "incidents_old.csv": """,CALL_CREATED_DATE,full.code,number,street,st_type,ï..AGENCY
1,2013-01-05,745  - Alarm,7, OAK,AV ,x
2,2013-01-06,745  - Alarm,7,OAK,AVE,x
""",
    "inspections.csv": """STREET_NUM,STREET_NAME,PARCEL,INSPECTION_DATE,INSPECTION_RESULT,VIOLATION
12,MAIN,P1,1/10/2014,Violations Found,A :: B
12,MAIN,P1,3/2/2014,Abated,A
7,OAK,P3,8/1/2014,Abated,
7,OAK,P3,2/2/2015,Abated,B :: B
1,X,P9,2/2/2014,Abated,B
""",
    "liens.csv": """pin,municipality,filing_date,tax_year,lien_description,amount,satisfied
P1,Riverton,2014-02-02,2014,CITY,100,0
P1,Riverton,2014-02-02,2014,CITY,100,0
P3,Riverton,2013-02-02,2013,SCHOOL,20,0
P2,Riverton,2016-02-02,2016,SCHOOL,30,0
P2,Riverton,2014-02-02,2014,CITY,,0
P1,Elsewhere,2014-02-02,2014,CITY,7,0
""",
}
CENSUS = """c0,c1,c2,HD01.VD01,HD02.VD01,HD01.VD02,HD02.VD02
Id,Id2,Geography,Estimate; Total:,Margin of Error; Total:,Estimate; {0},Margin of Error; {0}
g1,1,"Block Group 1, Census Tract 103, X",9,1,40,2
g2,2,"Block Group 2, Census Tract 201, X",9,1,55,2
g3,3,"Block Group 3, Census Tract 4.02, X",9,1,60,2
"""
KEEP = ["period", "tract", "block", "target"]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    for name, body in FILES.items():
        encoding = "latin-1" if name in ("assessments.csv", "incidents_old.csv") else "utf-8"
        with open(os.path.join(folder, name), "w", encoding=encoding) as out:
            out.write(body)
    for i, name in enumerate(residential.schemas.FILES["census"]):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
            out.write(CENSUS.format(f"V{i}"))
    return residential.read_sources(spark, str(folder))


@pytest.fixture(scope="module")
def prepared(sources):
    place = residential.Place("RIVERTON", "Riverton", "Riverton city")
    return residential.prepare(sources, place, rare_count=1, min_values=1)


def test_parcels(sources):
    found = cleaning.parcel_areas(sources.parcels, "Riverton city")
    assert sorted(tuple(r) for r in found.collect()) == [("P1", 10300, 1), ("P2", 10300, 1), ("P3", 20100, 2)]


def test_properties_and_lookup(sources):
    properties, lookup = cleaning.clean_properties(sources.assessments, "RIVERTON", 1)
    assert sorted(r["PARID"] for r in properties.collect()) == ["P1", "P2", "P3", "P8"]
    assert sorted(r["PARID"] for r in lookup.collect()) == ["P1", "P2", "P3", "P4", "P8"]
    assert "EMPTY" not in properties.columns


def test_census_key_is_exact(sources):
    rows = cleaning.clean_census(sources.census[0]).collect()
    assert sorted(tuple(r) for r in rows) == [(402, 3, 60.0), (10300, 1, 40.0), (20100, 2, 55.0)]


def test_profile(prepared):
    rows = {(r["tract"], r["block"]): r for r in prepared.profile.collect()}
    assert set(rows) == {(10300, 1), (20100, 2)}
    assert rows[10300, 1]["USEDESC"] == "SINGLE" and rows[10300, 1]["SALEPRICE"] == 100
    assert rows[20100, 2]["USEDESC"] == "TWO" and rows[20100, 2]["SALEPRICE"] == 50
    assert rows[20100, 2]["Estimate V3"] == 55


EXPECTED = {
    # period, tract: target, 735, 745, found, abated, A, B, amount, CITY, SCHOOL
    (2013, 10300): (0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (2013, 20100): (0, 0, 1, 0, 0, 0, 0, 20, 0, 1),
    (2014, 10300): (1, 2, 0, 1, 0, 1, 1, 100, 1, 0),
    (2014, 20100): (0, 0, 0, 0, 1, 0, 0, 0, 0, 0),
    (2015, 10300): (0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (2015, 20100): (0, 1, 0, 0, 1, 0, 1, 0, 0, 0),
}
COLUMNS = [
    "target", "incident__735 - Alarm", "incident__745 - Alarm", "inspection__Violations Found",
    "inspection__Abated", "inspection__A", "inspection__B", "lien__amount", "lien__CITY", "lien__SCHOOL",
]


def table(result):
    return {
        (r["period"].year, r["tract"]): tuple(r[c] for c in COLUMNS if c in result.panel.columns)
        for r in result.panel.collect()
    }


def test_panel(prepared):
    result = residential.residential_panel(prepared, min_ratio=None)
    assert table(result) == EXPECTED
    row = result.panel.where("period = date '2014-12-31' and tract = 10300").first()
    assert row["USEDESC__SINGLE"] == 1 and row["USEDESC__TWO"] == 0 and row["SALEPRICE"] == 100
    assert row["period"] == dt.date(2014, 12, 31)


def test_pruning_sees_the_full_outer_frame(prepared):
    result = residential.residential_panel(prepared, min_ratio=0.2)
    assert result.frame_rows == 8
    assert "lien__SCHOOL" in result.features
    for name in ("incident__745 - Alarm", "inspection__Violations Found", "inspection__A", "lien__CITY"):
        assert name in result.dropped


def test_options(prepared):
    later = residential.residential_panel(prepared, min_ratio=None, keep_unmatched_periods=True)
    rows = {(r["period"].year, r["tract"]): r["lien__SCHOOL"] for r in later.panel.collect()}
    assert len(rows) == 8 and rows[2016, 10300] == 1
    # A lien of the target's year carries the last day of the year, so the cutoff removes it.
    cut = residential.residential_panel(prepared, min_ratio=None, liens_cutoff=True)
    assert {r["lien__CITY"] for r in cut.panel.collect()} == {0}
    short = residential.residential_panel(prepared, min_ratio=None, until="2014-12-31")
    assert short.panel.count() == 4
    assert residential.training_matrix(short, "2013-12-31").count() == 2


def test_wide_pivot_equals_conditional_sums(spark, prepared, monkeypatch):
    narrow = residential.residential_panel(prepared, min_ratio=None).panel
    monkeypatch.setattr("riskpanel.operators.panel.WIDE_LIMIT", 0)
    wide = residential.residential_panel(prepared, min_ratio=None).panel
    assert narrow.columns == wide.columns
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))


def test_gap_years_and_row_order(spark):
    events = [(dt.date(2010, 5, 1), 1, "1x"), (dt.date(2010, 4, 1), 1, "2x"), (dt.date(2013, 4, 1), 2, "2x"), (None, 1, "2x")]
    areas = spark.createDataFrame([(1,), (2,), (3,)], "area int")
    results = []
    for data in (events, events[::-1]):
        df = spark.createDataFrame(data, "day date, area int, code string")
        source = EventSource("e", df, "day", one_hot=["code"], target=df["code"].startswith("1"))
        panel = build_panel(areas, [source], ["area"]).panel
        results.append(sorted((r["period"].year, r["area"], r["target"], r["e__2x"]) for r in panel.collect()))
    assert results[0] == results[1]
    assert len(results[0]) == 12
    assert (2010, 1, 1, 1) in results[0] and (2013, 2, 0, 1) in results[0] and (2011, 3, 0, 0) in results[0]


def test_times_of_day_against_a_midnight_cutoff(spark):
    areas = spark.createDataFrame([(1,), (2,)], "area int")
    calls = spark.createDataFrame([(dt.date(2010, 5, 1), 1, "1x"), (dt.date(2010, 1, 1), 2, "2x")], "day date, area int, code string")
    stamps = [(2010, 5, 1, 0), (2010, 5, 1, 9), (2010, 4, 30, 23), (2010, 12, 31, 5)]
    visits = spark.createDataFrame(
        [(dt.datetime(*s), a, "v") for s in stamps for a in (1, 2)], "at timestamp_ntz, area int, what string"
    )
    target = EventSource("call", calls, "day", one_hot=["code"], target=calls["code"].startswith("1"))
    visit = EventSource("visit", visits, "at", one_hot=["what"])
    panel = build_panel(areas, [target, visit], ["area"]).panel
    # Area 1 is cut at midnight of May 1; area 2 at midnight of December 31.
    assert {(r["period"].year, r["area"]): r["visit__v"] for r in panel.collect()} == {(2010, 1): 2, (2010, 2): 3}


def test_target_times_of_day_are_compared_exactly(spark):
    areas = spark.createDataFrame([(1,)], "area int")
    rows = [(dt.datetime(2010, 5, 1, 12), "1x"), (dt.datetime(2010, 5, 1, 11), "2x"), (dt.datetime(2010, 5, 1, 13), "2x")]
    calls = spark.createDataFrame([(d, 1, c) for d, c in rows], "at timestamp_ntz, area int, code string")
    source = EventSource("call", calls, "at", one_hot=["code"], target=calls["code"].startswith("1"))
    row = build_panel(areas, [source], ["area"]).panel.first()
    assert row["target"] == 1 and row["call__2x"] == 1


def test_category_limit_is_passed_on(spark, prepared):
    assert residential.residential_panel(prepared, min_ratio=None, max_categories=None).features
    with pytest.raises(ValueError, match="more than 0 values"):
        residential.encode_profile(prepared.profile, max_categories=0)
    df = spark.createDataFrame([("a;b",), ("c",), (None,)], "x string")
    assert columns.categories(df, "x", None) == ["a;b", "c"] == columns.categories_of(df, ["x"], None)["x"]
    assert columns.label_categories(df, "x", ";", None) == ["a", "b", "c"]

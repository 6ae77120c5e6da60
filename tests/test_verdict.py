"""Cases that once went wrong: date shapes, column order, null keys, equal names, nominal features."""

import datetime as dt

import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler

from riskpanel.functions.dates import parse_date, parse_timestamp
from riskpanel.operators.adaboost import AdaBoost
from riskpanel.operators.joins import outer_join_all
from riskpanel.plans import cleaning
from riskpanel.sources import readers

MOMENTS = {
    "2015-03-04": (2015, 3, 4), "2015-03-04T10:11:12": (2015, 3, 4, 10, 11, 12), "2015-03-04T10:11:12.000": (2015, 3, 4, 10, 11, 12),
    "2015-03-04 10:11:12.5": (2015, 3, 4, 10, 11, 12, 500000), "2015-03-04T10:11:12Z": (2015, 3, 4, 10, 11, 12),
    "2015-03-04 10:11:12 +0200": (2015, 3, 4, 10, 11, 12), "3/4/15": (2015, 3, 4), "12/31/99": (1999, 12, 31),
    "3/4/2015 12:05 AM": (2015, 3, 4, 0, 5), "3/4/2015 1:05:06 PM": (2015, 3, 4, 13, 5, 6), "04-MAR-2015": (2015, 3, 4),
    "March 4, 2015 10:11": (2015, 3, 4, 10, 11), "20150304": (2015, 3, 4), "20150304T101112": (2015, 3, 4, 10, 11, 12),
    "2015/3/4 9:05": (2015, 3, 4, 9, 5), "2015-03-08 02:30:00": (2015, 3, 8, 2, 30), "2015-02-30": None, "hello": None,
    "13/45/2015": None, "3/4/2015 13:00 PM": None, "": None, None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_date_shapes(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in MOMENTS], "raw string")
        rows = df.select("raw", parse_timestamp("raw").alias("t"), parse_date("raw").alias("d")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = {k: v and dt.datetime(*v) for k, v in MOMENTS.items()}
    assert {r.raw: r.t for r in rows} == want
    assert {r.raw: r.d for r in rows} == {k: v and v.date() for k, v in want.items()}


def test_liens_with_unread_dates_stay_apart(spark):
    rows = [("P", "R", raw, 2014, "x", 1.0, "n") for raw in ("2014-02-02T00:00:00", "2014-02-02", "soon", "later", "soon")]
    liens = spark.createDataFrame(rows, "pin string, municipality string, filing_date string, tax_year int, lien_description string, amount double, satisfied string")
    lookup = spark.createDataFrame([("P",)], "PARID string")
    found = [r.filing_date for r in cleaning.clean_liens(liens, lookup, "R").collect()]
    assert sorted(found, key=str) == [dt.date(2014, 2, 2), None, None]


def test_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y\n1,ax,ay\n")
    (tmp_path / "b.csv").write_text("id,y,x,z\n2,by,bx,bz\n")
    got = readers.read_csv(spark, str(tmp_path)).select("id", "x", "y", "z").collect()
    assert sorted(map(tuple, got), key=str) == [("1", "ax", "ay", None), ("2", "bx", "by", "bz")]


def test_census_rows_without_a_key_do_not_multiply(spark):
    tables = [spark.createDataFrame([(1, 1, float(k))] + [(None, None, 0.0)] * 20, "tract long, block long, v double") for k in range(4)]
    combined = cleaning.combine_census(tables)
    assert combined.count() == 1 and len(set(combined.columns)) == 6


def test_equal_names_get_suffixes(spark):
    a, b = (spark.createDataFrame([(1, v)], "k long, v string") for v in "ab")
    assert outer_join_all([a, b], ["k"]).first().asDict() == {"k": 1, "v_x": "a", "v_y": "b"}


def test_boosting_cuts_nominal_features(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0)] * 20 + [("a", 0.0)], "what string, label double")
    indexed = StringIndexer(inputCol="what", outputCol="what_index").fit(df).transform(df)
    rows = VectorAssembler(inputCols=["what_index"], outputCol="features").transform(indexed)
    model = AdaBoost(rounds=3).fit(rows.select("features", "label"))
    assert model.stumps[0].feature == 0
    assert model.transform(rows.select("features", "label")).where("prediction <> label").count() == 0

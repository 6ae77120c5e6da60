import datetime as dt

from pyspark.sql import functions as F

from riskpanel.functions import dates, numbers, text


def one(spark, column, schema="v string", value=None):
    return spark.createDataFrame([(value,)], schema).select(column.alias("out")).first()["out"]


def test_strip_removes_all_white_space(spark):
    assert one(spark, text.strip("v"), value="\t\xa0 a b　\n") == "a b"


def test_missing_tokens(spark):
    df = spark.createDataFrame([("NA",), ("",), ("x",), (None,), ("nan",)], "v string")
    assert [r[0] for r in df.select(text.missing_to_null("v")).collect()] == [None, None, "x", None, None]


def test_street_type_parity_and_intent(spark):
    assert one(spark, text.normalise_street_type("v"), value="AVE") == "AVEE"
    assert one(spark, text.normalise_street_type("v"), value="NAVY") == "NAVEY"
    assert one(spark, text.normalise_street_type("v", whole_word=True), value="AVE") == "AVE"
    assert one(spark, text.normalise_street_type("v", whole_word=True), value="OAK AV") == "OAK AVE"


def test_clean_street_order(spark):
    assert one(spark, text.clean_street("v"), value="MAIN ST, PGH #4") == "MAIN ST"
    assert one(spark, text.clean_street("v"), value=" OAK, PARK, X#1, PGH") == "OAKARK X"


def test_join_strict_and_first_part(spark):
    df = spark.createDataFrame([("a", None), ("a", "b/c")], "x string, y string")
    rows = df.select(text.join_strict(" ", "x", "y"), text.first_part("y", "/")).collect()
    assert [tuple(r) for r in rows] == [(None, None), ("a b/c", "b")]


def test_extract_groups(spark):
    df = spark.createDataFrame([("Block Group 3, Census Tract 4.02, X",), ("none",), (None,)], "v string")
    block, tract = text.extract_groups("v", text.GEOGRAPHY_PATTERN, 2)
    rows = [tuple(r) for r in df.select(block, tract, numbers.scaled_key(tract)).collect()]
    assert rows == [("3", "4.02", 402), (None, None, None), (None, None, None)]


def test_scaled_key_has_no_rounding_noise(spark):
    df = spark.createDataFrame([(f"{i / 100:.2f}",) for i in range(0, 1000)], "v string")
    assert [r[0] for r in df.select(numbers.scaled_key("v")).collect()] == list(range(0, 1000))


def test_split_labels(spark):
    assert one(spark, text.split_labels("v"), value="B :: A ::  :: B") == ["B", "A"]
    assert one(spark, text.split_labels("v"), value=None) is None


def test_target_flag_of_null_is_zero(spark):
    df = spark.createDataFrame([("111 - x",), ("735",), (None,)], "v string")
    assert [r[0] for r in df.select(text.target_flag("v")).collect()] == [1, 0, 0]


def test_dates(spark):
    df = spark.createDataFrame([("2014-03-01",), ("3/1/2014",), ("14-31-2",), (None,)], "v string")
    rows = [r[0] for r in df.select(dates.parse_date("v")).collect()]
    assert rows == [dt.date(2014, 3, 1), dt.date(2014, 3, 1), None, None]
    rejects = df.select("v", dates.parse_date("v").alias("d")).agg(dates.count_rejects("v", "d")).first()[0]
    assert rejects == 1


def test_period_ends_and_ranges_agree(spark):
    day = dt.date(2016, 2, 10)
    expected = {
        "year": dt.date(2016, 12, 31), "quarter": dt.date(2016, 3, 31), "month": dt.date(2016, 2, 29),
        "week": dt.date(2016, 2, 14), "day": day,
    }
    for period, end in expected.items():
        got = spark.range(1).select(dates.period_end(F.lit(day), period)).first()[0]
        assert got == end
        stepped = [end]
        while len(stepped) < 30:
            stepped.append(dates.next_period_end(stepped[-1], period))
        listed = spark.range(1).select(dates.period_range(F.lit(end), F.lit(stepped[-1]), period)).first()[0]
        assert listed == stepped


def test_bins_and_f1(spark):
    df = spark.createDataFrame([(0.3,), (0.7,), (1.0,), (0.29999,), (1.1,), (None,)], "v double")
    assert [r[0] for r in df.select(numbers.bin_index("v", [0, 0.3, 0.7, 1])).collect()] == [1, 2, 2, 0, None, None]
    assert spark.range(1).select(numbers.f1_score(F.lit(0.0), F.lit(0.0))).first()[0] is None

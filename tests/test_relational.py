"""Null rules, schema operators, joins and aggregates on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from riskpanel.operators import aggregate, columns, filters, joins


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_differs_keeps_null(spark):
    df = spark.createDataFrame([("0",), ("",), (None,), ("5",)], "h string")
    assert rows(df.where(filters.differs("h", "0", ""))) == [(None,), ("5",)]


def test_not_matching_is_anchored_and_keeps_null(spark):
    df = spark.createDataFrame([("Some County",), ("x",), (None,)], "p string")
    assert rows(filters.not_matching(df, "p", ".*County")) == [(None,), ("x",)]
    assert rows(filters.not_matching(df, "p", "ome")) == [(None,), ("Some County",), ("x",)]


def test_drop_rare(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",), ("1c",), (None,)], "code string")
    expected = [(None,), ("1c",), ("a",), ("a",), ("a",)]
    assert rows(filters.drop_rare(df, "code", 2, "1")) == expected
    assert rows(filters.drop_rare(df, "code", 2, "1", max_listed=0)) == expected
    assert rows(filters.drop_rare(df, "code", 1)) == rows(df)


def test_strict_drop(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(KeyError):
        columns.drop_columns(df, ["zz"])
    assert columns.drop_columns(df, ["zz", "a"], strict=False).columns == ["b"]


def test_promote_header(spark):
    df = spark.createDataFrame([("Id", "Name. x"), ("1", "n"), (None, "m")], "c0 string, c1 string")
    out = columns.promote_header(df, "Id")
    assert out.columns == ["Id", "Name. x"]
    assert rows(out) == [(None, "m"), ("1", "n")]


def test_sparse_and_low_sum(spark):
    df = spark.createDataFrame([(1, None, -5), (1, 2, 1), (1, None, 1)], "a int, b int, c int")
    assert columns.drop_sparse(df, min_count=2).columns == ["a", "c"]
    assert columns.drop_sparse(df, min_fraction=1 / 3).columns == ["a", "b", "c"]
    assert columns.drop_low_sum(df, 0.0).columns == ["a", "b"]


def test_feature_names_do_not_collide():
    assert columns.feature_names("s", ["a.b", "a_b", "x"]) == {"a.b": "s__a_b", "a_b": "s__a_b_2", "x": "s__x"}


def test_too_many_categories_is_an_error(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError):
        columns.categories(df, "v", limit=10)
    assert len(columns.categories(df, "v", limit=20)) == 20


def test_one_hot_labels(spark):
    df = spark.createDataFrame([("A :: B",), ("B :: B",), (None,)], "v string")
    out = columns.one_hot_labels(df, "v")
    assert out.columns == ["v", "v__A", "v__B"]
    assert rows(out) == [(None, 0, 0), ("A :: B", 1, 1), ("B :: B", 0, 1)]


def test_outer_join_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(None, "m"), (2, "y")], "k int, b string")
    assert rows(joins.outer_join_all([a, b], ["k"])) == [(None, "n", "m"), (1, "x", None), (2, None, "y")]


def test_outer_join_dates_keeps_both_dates(spark):
    a = spark.createDataFrame([("d1", 1, 10)], "da string, k int, a int")
    b = spark.createDataFrame([("d1", 1, 20), ("d2", 1, 30)], "db string, k int, b int")
    out = joins.outer_join_dates(a, b, "da", "db", ["k"]).select("k", "da", "db", "a", "b")
    assert rows(out) == [(1, None, "d2", None, 30), (1, "d1", "d1", 10, 20)]


def test_lookup_fans_out_and_semi_does_not(spark):
    left = spark.createDataFrame([("p",), ("q",)], "id string")
    right = spark.createDataFrame([("p", 1), ("p", 2)], "pin string, block int")
    assert rows(joins.left_lookup(left, right, {"id": "pin"})) == [("p", 1), ("p", 2), ("q", None)]
    assert rows(joins.semi_join(left, right, {"id": "pin"})) == [("p",)]


def test_group_profile_ties_nulls_and_null_keys(spark):
    df = spark.createDataFrame(
        [(1, "b", "x", 1.0), (1, "a", None, None), (2, None, None, 4.0), (None, "z", "z", 9.0)],
        "k int, m string, n string, v double",
    )
    out = aggregate.group_profile(df, ["k"], ["m", "n"], ["v"])
    assert rows(out) == [(1, "a", "x", 1.0), (2, None, None, 4.0)]
    assert rows(aggregate.group_profile(df, ["k"], [], ["v"], exact_scale=2)) == [(1, 1.0), (2, 4.0)]


def test_best_row_first_on_ties(spark):
    df = spark.createDataFrame([(0, None), (1, 0.5), (2, 0.7), (3, 0.7)], "i int, f double")
    assert rows(aggregate.best_row(df, "f", ["i"])) == [(2, 0.7)]
    assert rows(aggregate.rows_at_max(df, "f")) == [(2, 0.7), (3, 0.7)]
    assert rows(aggregate.top_k(df, "f", 1, ["i"], descending=False)) == [(0, None)]

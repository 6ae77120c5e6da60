"""Ordered scans against plain Python on data with a hot group."""

import random

import pytest
from pyspark.sql import functions as F

from riskpanel.operators import timeorder


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        group = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        data.append((group, i, rng.choice([None, i % 17, None]), rng.randrange(5)))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "g string, i int, v int, w int").repartition(7).cache()


def by_group(data):
    groups = {}
    for row in sorted(data, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("limit", [0, 10**6])
def test_forward_fill(hot, limit):
    data, df = hot
    expected = set()
    for rows in by_group(data).values():
        last = None
        for g, i, v, w in rows:
            last = v if v is not None else last
            expected.add((g, i, last, w))
    assert {tuple(r) for r in timeorder.forward_fill(df, ["g"], ["i"], ["v"], limit).collect()} == expected


@pytest.mark.parametrize("limit", [0, 10**6])
def test_running_sums_and_following(hot, limit):
    data, df = hot
    expected = set()
    for rows in by_group(data).values():
        total = 0
        for n, (g, i, v, w) in enumerate(rows):
            total += w
            expected.add((g, i, total, rows[n + 1][3] if n + 1 < len(rows) else None))
    out = timeorder.running_sums(df, ["g"], [F.col("i").asc()], {"t": F.col("w")}, {"nw": F.col("w")}, limit)
    assert {tuple(r) for r in out.select("g", "i", "t", "nw").collect()} == expected


def test_hot_group_is_spread(spark):
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.col("id").alias("i")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = timeorder.range_partitioned(df, [F.col("g").asc(), F.col("i").asc()]).groupBy("__part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 5000
    assert timeorder.largest_group(df, ["g"]) == 20000 and timeorder.largest_group(df.limit(0), ["g"]) == 0


@pytest.mark.parametrize("n,k", [(10, 3), (11, 3), (3, 3), (2, 3), (97, 7)])
def test_expanding_folds(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("x")).repartition(5)
    rows = {r["x"]: (r["row_index"], r["test_fold"]) for r in timeorder.expanding_folds(df, ["x"], k).collect()}
    size = n // (k + 1)
    for x in range(n):
        expected = -1 if x < n - k * size else (x - (n - k * size)) // size
        assert rows[x] == (x, expected)


def test_folds_do_not_overlap_in_time(spark):
    df = spark.range(50).select(F.col("id").alias("x")).repartition(4)
    folded = timeorder.expanding_folds(df, ["x"], 4)
    for fold in range(4):
        train = timeorder.fold_train(folded, fold).agg(F.max("x")).first()[0]
        test = timeorder.fold_test(folded, fold).agg(F.min("x"), F.count("*")).first()
        assert train < test[0] and test[1] == 10


def test_period_folds_keep_periods_whole(spark):
    df = spark.range(100).select((F.col("id") / 10).cast("int").alias("p"))
    rows = timeorder.period_folds(df, "p", 3).distinct().collect()
    assert len(rows) == 10
    assert sorted(r["test_fold"] for r in rows) == [-1] * 4 + [0, 0, 1, 1, 2, 2]

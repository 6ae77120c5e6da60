"""Bounded summaries of scores against exact areas."""

import random

import pytest

from riskpanel.operators import curves


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, s double, y int")


def rows_of(seed, n, scores):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.choice(scores) if scores else rng.random()
        out.append((rng.choice("ab"), s, int(rng.random() < 0.2 + 0.5 * s)))
    return out


@pytest.mark.parametrize("buckets", [1, 7, 64, 4096])
def test_exact_area_is_within_the_error(spark, buckets):
    df = frame(spark, [*rows_of(1, 1500, None), ("a", None, 1)])
    exact = {r.g: r.auc for r in curves.auc(df.where("s is not null"), "s", "y", ["g"]).collect()}
    for r in curves.bucketed_auc(df, "s", "y", ["g"], buckets).collect():
        assert abs(r.auc - exact[r.g]) <= r.error + 1e-12
        assert r.error <= (0.5 if buckets == 1 else 0.6 / buckets)


def test_few_scores_are_exact(spark):
    df = frame(spark, rows_of(2, 800, [k / 8 for k in range(9)]))
    exact = {r.g: r.auc for r in curves.auc(df, "s", "y", ["g"]).collect()}
    got = curves.bucketed_auc(df, "s", "y", ["g"]).collect()
    assert {r.g: pytest.approx(r.auc) for r in got} == exact and all(r.error == 0 for r in got)


def test_summaries_merge(spark):
    first, second = (frame(spark, rows_of(k, 300, None)) for k in (3, 4))
    parts = [curves.bucket_counts(df, "s", "y", ["g"], 50, (0.0, 1.0)) for df in (first, second)]
    merged = curves.auc_of_buckets(curves.merge_buckets(parts[0].unionByName(parts[1]), ["g"]), ["g"])
    whole = curves.auc_of_buckets(curves.bucket_counts(first.unionByName(second), "s", "y", ["g"], 50, (0.0, 1.0)), ["g"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_one_class_or_no_rows(spark):
    assert curves.bucketed_auc(frame(spark, [("a", 0.5, 1), ("a", 0.5, 1)]), "s", "y", ["g"]).first().auc is None
    assert curves.bucketed_auc(frame(spark, []), "s", "y", ["g"]).count() == 0

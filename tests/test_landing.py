"""Readers and sinks for many and for large files."""

import csv
import io
import random
import uuid

import pytest
from pyspark.sql import functions as F

from riskpanel.operators.timeorder import expanding_folds, row_index
from riskpanel.sources import readers, sinks


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def rows_with_breaks(seed, n):
    rng = random.Random(seed)
    cells = ["", "x", "a, b", 'say "hi"', "two\nlines", "\n", "three\n\nlines, \"quoted\"", "l" * 400, "m\n" * 150, "é"]
    return [[str(k), rng.choice(cells), rng.choice(cells)] for k in range(n)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_quoted_breaks_over_many_tasks(spark, small_blocks, tmp_path, seed, encoding):
    """Blocks far shorter than some records: the rows are those of a reader that sees the file whole."""
    want = []
    for k in range(3):
        rows = rows_with_breaks(seed * 10 + k, 40)
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows([["id", "a", "b"], *rows])
        (tmp_path / f"{k}.csv").write_bytes(text.getvalue().encode(encoding))
        want += [tuple(c or None for c in r) for r in rows]
    df = readers.read_csv(spark, str(tmp_path), encoding=encoding, missing=(), multi_line=True)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    lines = spark.read.text(str(tmp_path))
    assert lines.select(F.spark_partition_id()).distinct().count() > 10
    assert readers.quoted_records(spark, [str(tmp_path)], encoding)[1].count() == 0


def test_unclosed_quotes_are_named(spark, small_blocks, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,\"x\ny\"\n")
    (tmp_path / "bad.csv").write_text("a,b\n1,x\n2,\"open\n" + "more\n" * 200)
    records, unclosed = readers.quoted_records(spark, [str(tmp_path)])
    assert [r.file.rsplit("/", 1)[1] for r in unclosed.collect()] == ["bad.csv"]
    assert sorted(len(r.text.split("\n")) for r in records.collect()) == [1, 2, 201]


def test_headers_of_all_files_in_one_job(spark, tmp_path):
    for k in range(40):
        names = "b,a" if k % 3 else "a,b"
        (tmp_path / f"file {k}.csv").write_text(f"{names}\n{k},{k}\n" + "7,8\n" * (k % 5))
    (tmp_path / "empty.csv").write_text("")
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "headers")
    found = readers.headers(spark, str(tmp_path), "UTF-8", ",")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # A sort of the few lines may sample them in a job of its own; the number of files does not matter.
    assert len(jobs) <= 4
    assert {tuple(names): len(files) for names, files in found} == {("a", "b"): 14, ("b", "a"): 26}
    df = readers.read_csv(spark, str(tmp_path))
    assert df.count() == 40 + sum(k % 5 for k in range(40))
    assert df.where("a = '8' and b = '7' or a = '7' and b = '8'").count() == sum(k % 5 for k in range(40))


def test_headers_of_large_files(spark, small_blocks, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("id,v\n" + "".join(f"{i},x{k}\n" for i in range(400)))
    assert [(names, len(files)) for names, files in readers.headers(spark, str(tmp_path), "UTF-8", ",")] == [(["id", "v"], 3)]


def test_row_numbers_do_not_grow_the_plan(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    sizes = []
    for n in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        indexed = row_index(df, ["v"])
        assert [tuple(r) for r in indexed.orderBy("v").collect()] == [(k, k, 1000) for k in range(1000)]
        sizes.append(len(indexed._jdf.queryExecution().optimizedPlan().toString()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sizes[1] < 1.1 * sizes[0]
    assert row_index(df.where("v < 0"), ["v"]).count() == 0
    assert expanding_folds(df.where("v < 0"), ["v"], 3).columns == ["v", "row_index", "row_total", "test_fold"]


def test_a_repeated_run_replaces_its_steps(spark, tmp_path):
    sweep = spark.createDataFrame([(k, f"f{k}", 0.1 * k) for k in range(3)], "step int, Last_Feature string, Thresh double")
    for part in (sweep, sweep, sweep.where("step = 1").withColumn("Thresh", F.lit(9.0))):
        path = sinks.append_sweep(part, str(tmp_path), "run1")
    got = {r.step: r.Thresh for r in readers.read_csv(spark, path).collect()}
    assert got == {"0": "0.0", "1": "9.0", "2": "0.2"} and readers.read_csv(spark, path).count() == 3
    other = sinks.append_sweep(sweep, str(tmp_path), "run2")
    assert other != path and readers.read_csv(spark, path).count() == 3

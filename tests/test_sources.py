import json

from pyspark.sql import types as T

from riskpanel.sources import readers, sinks


def test_csv_by_name_with_tokens_and_encoding(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("ï..A,n,extra\né,NA,1\n,7,2\n\"x, \"\"q\"\"\",2014.0,3\n".encode("latin-1"))
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("A", T.StringType())])
    df = readers.read_csv(spark, str(path), schema, "ISO-8859-1", select_declared=True)
    assert [tuple(r) for r in df.collect()] == [(None, "é"), (7, None), (2014, 'x, "q"')]
    assert readers.read_csv(spark, str(path), schema, "ISO-8859-1").columns == ["A", "n", "extra"]


def test_missing_declared_column(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a\n1\n")
    try:
        readers.read_csv(spark, str(path), T.StructType([T.StructField("b", T.LongType())]))
    except ValueError as error:
        assert "b" in str(error)
    else:
        raise AssertionError("expected an error")


def test_several_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"k,v\n{i},x\n")
    df = readers.read_csv(spark, [str(tmp_path / f"{i}.csv") for i in range(3)])
    assert sorted(r["k"] for r in df.collect()) == ["0", "1", "2"]


def test_json_records_and_spec(spark, tmp_path):
    records = [{"pin": "a", "owner": {"name": "n"}, "tax_year": 2009}, {"pin": "b", "owner": None, "tax_year": 2001}]
    (tmp_path / "t.json").write_text(json.dumps({"result": {"records": records}}, indent=1))
    schema = T.StructType.fromDDL("pin string, owner struct<name: string>, tax_year int")
    df = readers.read_json_records(spark, str(tmp_path / "t.json"), schema, one_per_file=True)
    table = readers.table_from_spec(df, {"id": "pin", "owner_name": "owner.name", "tax_year": "tax_year"})
    assert [tuple(r) for r in table.orderBy("id").collect()] == [("a", "n", 2009), ("b", None, 2001)]
    assert readers.filtered_scan(table, "tax_year > 2008", ["id"]).collect()[0]["id"] == "a"


def test_scan_is_pruned_and_filtered(spark, tmp_path):
    path = sinks.land(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), str(tmp_path / "t"))
    plan = readers.filtered_scan(spark.read.parquet(path), "a > 0", ["b"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,0)]" in plan
    assert "ReadSchema: struct<a:int,b:int>" in plan


def test_sinks(spark, tmp_path):
    sweep = spark.createDataFrame([("f", 0.1)], "Last_Feature string, Thresh double")
    for _ in range(2):
        path = sinks.append_sweep(sweep, str(tmp_path), "run1")
    back = readers.read_csv(spark, path)
    assert back.columns == ["Last_Feature", "Thresh"] and back.count() == 2
    importances = spark.createDataFrame([(f"f{i}", float(i)) for i in range(60)], "feature string, importance double")
    best = readers.read_csv(spark, sinks.write_importances(importances, str(tmp_path), "run1"))
    assert best.count() == 50 and best.where("feature = 'f10'").count() == 1 and best.where("feature = 'f9'").count() == 0
    matrix = sinks.write_training_matrix(sweep, str(tmp_path / "m"), as_csv=True)
    assert readers.read_csv(spark, matrix).count() == 1

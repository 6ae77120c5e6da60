"""Work and memory that must not grow with the rows where the input allows it."""

import time

from pyspark.sql import functions as F

from riskpanel import session
from riskpanel.llm import pii
from riskpanel.operators import panel
from riskpanel.plans import cleaning

TEXTS = ["1/2/1996", " 1/2/1996", "1996-01-02T03:04:05", "05-FEB-1997", "no date", "", None]


def test_a_date_text_is_read_once(spark):
    """Inspections, liens and incidents by looked-up moments equal those read row by row, and the row plan parses nothing."""
    rows = [(f"P{k % 3}", text, "A", "x :: y") for k in range(9) for text in TEXTS]
    inspections = spark.createDataFrame(rows, "PARCEL string, INSPECTION_DATE string, INSPECTION_RESULT string, VIOLATION string")
    inspections = inspections.withColumns({"STREET_NUM": F.lit("1"), "STREET_NAME": F.lit("A")})
    liens = inspections.select(
        F.col("PARCEL").alias("pin"), F.lit("R").alias("municipality"), F.col("INSPECTION_DATE").alias("filing_date"),
        F.lit(1996).alias("tax_year"), F.lit("d").alias("lien_description"), F.lit(1.0).alias("amount"), F.lit("F").alias("satisfied"),
    )
    incidents = inspections.select(
        F.lit("135 - FIRE").alias("full.code"), F.lit("A").alias("street"), F.lit("ST").alias("st_type"), F.lit("1").alias("number"),
        F.col("INSPECTION_DATE").alias("CALL_CREATED_DATE"),
    )
    lookup = spark.createDataFrame([("P0",), ("P1",)], "PARID string")
    columns = cleaning.date_columns(inspections, liens, [incidents, incidents.drop("st_type")])
    texts = cleaning.moments_of(columns)
    assert texts.groupBy("source").count().collect() and texts.count() == 3 * (len(TEXTS) - 1)
    assert cleaning.rejects_of(texts) == {"inspections": 18, "liens": 18, "incidents": 36}
    of = {name: texts.where(F.col("source") == name) for name in columns}

    def both(clean, name):
        looked_up, read = clean(of[name]), clean(None)
        assert looked_up.schema == read.schema
        assert sorted(map(repr, looked_up.collect())) == sorted(map(repr, read.collect()))

    both(lambda m: cleaning.clean_inspections(inspections, lookup, m), "inspections")
    both(lambda m: cleaning.clean_liens(liens, lookup, "R", m), "liens")
    both(lambda m: cleaning.clean_incidents(incidents, incidents.drop("st_type"), 1, moments=m), "incidents")
    known = spark.createDataFrame([("1/2/1996", None)], "text string, moment timestamp_ntz")
    plan = cleaning.clean_inspections(inspections, lookup, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan


def test_shuffles_follow_the_input(spark, tmp_path, monkeypatch):
    """Many small partitions for large files, whatever the session's number, which holds again afterwards."""
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = session.input_bytes(table, table)
    assert size == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(session, "PARTITION_INPUT", size // 40)
    monkeypatch.setattr(session, "PARTITION_READ", 1 << 15)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(name) for name in names]
    source = panel.EventSource("e", table.select(F.lit("1996-01-01").cast("date").alias("day"), "id", F.lit("a").alias("kind")), "day", one_hot=["kind"])
    seen = []
    monkeypatch.setattr(panel, "cut_lineage", lambda df: seen.append(spark.conf.get(names[0])) or df.localCheckpoint())
    areas, first = table.select("id"), spark.createDataFrame([], "period date, id bigint, first_date date")
    assert panel.source_panel(source, areas, ["id"], first=first).count() == 20_000
    assert [int(n) for n in seen] == [-(-size // (size // 40))]
    assert [spark.conf.get(name) for name in names] == before
    assert [session._bytes_of(x) for x in ("64MB", "8m", "1024", "1g")] == [64 << 20, 8 << 20, 1024, 1 << 30]


def test_texts_beyond_ascii_cost_little_more():
    """Looking for look-alike characters takes no large part of the search, whatever the text's characters."""

    def seconds(text):
        took = []
        for _ in range(3):
            start = time.process_time()
            assert pii.all_spans(text) == ([], [])
            took.append(time.process_time() - start)
        return min(took)

    words = "plain words of a text without any personal data in it, "
    assert seconds(words.replace("a", "é") * 10_000) < 2.5 * seconds(words * 10_000)

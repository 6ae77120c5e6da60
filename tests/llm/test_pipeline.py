"""The pipeline's stages against plain versions, and its registration."""

import os
from collections import Counter

import __spark_entry__
import corpus_pipeline
import plain
import pytest
from corpus_tables import edge_rows, frame
from riskpanel.llm import pii
from test_other import check_bins
from test_rowwise import toxic_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of edge cases and of toxic and ordinary documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels, _ = toxic_rows(600)
    frame(spark, [*edge_rows(), *((1000 + d, t) for d, t in rows)]).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + d, t) for d, t in labels], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stage_names():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    assert "pipeline" in __spark_entry__.queries()


def test_stages_against_plain_versions(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = stages["toxicity"](spark, docs, folder).cache()
    assert clean.columns == COLUMNS
    _, _, truth = toxic_rows(600)
    kept = {r.doc_id for r in clean.collect()}
    toxic = {1000 + d for d, t in truth.items() if t}
    assert len(toxic & kept) < 0.25 * len(toxic) and len({d for d in truth if not truth[d] and 1000 + d not in kept}) <= 8
    assert {d for d, _ in edge_rows()} <= kept

    single = stages["near_dedup"](spark, clean, folder).cache()
    assert single.columns == COLUMNS
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    # Every distinct id and text is a document of its own, in the order of the ids.
    nodes = sorted({(d, t or "") for d, t in rows if d is not None})
    groups = plain.near_groups([(k, t) for k, (_, t) in enumerate(nodes)], 5, 80)
    want = Counter(nodes[k][0] for k, root in groups.items() if k == root)
    want[None] = sum(d is None for d, _ in rows)
    assert Counter(r.doc_id for r in single.collect()) == want

    masked = stages["pii"](spark, single, folder).cache()
    assert masked.columns == COLUMNS
    want = Counter((r.doc_id, None if r.text is None else pii.masked(r.text)) for r in single.collect())
    assert Counter((r.doc_id, r.text) for r in masked.collect()) == want

    mixed = stages["mixing"](spark, masked, folder).cache()
    assert mixed.columns == COLUMNS
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in masked.collect()}

    packed = stages["packing"](spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())
    check_bins(packed, 2048)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and check_bins(rows, 2048) > 0


def test_run_on_empty_tables(spark, tmp_path):
    frame(spark, []).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_their_own_names(spark, folder, edges):
    """Extra columns named as the stages name theirs come through unchanged."""
    docs = frame(spark, edges)
    for name in ("near_dedup", "mixing"):
        got = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
        rest = [c for c in docs.columns if c not in (*COLUMNS, "copy", "rate")]
        assert set(rest) <= set(got.columns)
        assert got.count() and got.where(" or ".join(f"`{c}` <> 'x'" for c in rest)).count() == 0


def test_queries_are_whole_and_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert os.path.exists(corpus_pipeline.__file__)

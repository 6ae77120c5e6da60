"""Record lists of JSON documents over many blocks against a parser that sees the documents whole."""

import json
import random

import pytest

from riskpanel.sources.json_documents import json_document_records, read_json_document
from tests.test_landing import small_blocks  # noqa: F401

ODD_TEXTS = ["", "}", "{", '"', "\\", '\\"}', "]}{[", "é}\n", '"records": [{', "x" * 900, "}" * 300, ', "result": {"records": [']


def record(rng, k):
    text = rng.choice(ODD_TEXTS)
    more = rng.choice([None, {}, [], {"records": [{"k": -1}]}, [{"result": {"records": [{}]}}], {"a": {"b": [1, "}"]}}])
    return {"k": k, rng.choice(["text", "t}", 'q"']): text, "more": more}


def document(rng, n):
    others = [[1, 2], [{"k": -2}], "no", 5, None]
    records = [rng.choice(others) if rng.random() < 0.1 else record(rng, k) for k in range(n)]
    result = {"fields": [{"id": "a}"}, {"records": [{"k": -3}]}], "records": records, "links": {"records": [{"k": -4}]}}
    return {"help": rng.choice(ODD_TEXTS), "records": [{"k": -5}], "result": result, "other": {"records": [{"k": -6}]}}


@pytest.mark.parametrize("indent", [None, 1])
def test_records_over_many_blocks(spark, small_blocks, tmp_path, indent):  # noqa: F811
    rng = random.Random(7)
    want = []
    for f in range(3):
        found = [document(rng, n) for n in (60, 0, 9)]
        (tmp_path / f"{f}.json").write_text("\n".join(json.dumps(d, indent=indent) for d in found) + "\n")
        want += [r for d in found for r in d["result"]["records"] if isinstance(r, dict)]
    read = json_document_records(spark, str(tmp_path))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = [json.loads(r.text) for r in read.collect()]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_lists_at_the_top_and_none_at_all(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2, "x": [{"k": 9}]}, 3]')
    assert sorted(r.k for r in read_json_document(spark, str(tmp_path), "k int", at="").collect()) == [1, 2]
    assert read_json_document(spark, str(tmp_path), "k int").count() == 0
    (tmp_path / "a.json").write_text('{"result": {"records": [{"k": 1}, {"k": 2')
    with pytest.raises(ValueError, match="cut off"):
        json_document_records(spark, str(tmp_path))
    (tmp_path / "a.json").write_text("")
    assert read_json_document(spark, str(tmp_path), "k int").count() == 0
    with pytest.raises(ValueError):
        json_document_records(spark, str(tmp_path), at='a"b')

"""Packing, mixing, top-k search, archives and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import pytest
from corpus_tables import frame
from pyspark.sql import functions as F
from riskpanel.llm import mixing, packing, topk, warc
from riskpanel.llm.crawl import page_of, page_records
from riskpanel.session import ensure_checkpoint_dir

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("word_bpe_49k.json")


def check_bins(rows, capacity):
    """Gapless places within the capacity, every sequence from 0."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packed_documents(edge_docs, edges, no_docs, capacity):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(edge_docs, VOCABULARY, capacity).collect()
    want = Counter()
    for (d, _), x in zip(edges, Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for _, t in edges], add_special_tokens=False)):
        ids = np.array([*x.ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = check_bins(rows, capacity)
    assert n <= -(-sum(r.length for r in rows) // capacity) * 1.1 + 1
    assert packing.pack_documents(no_docs, VOCABULARY, capacity).count() == 0


def test_plans_hold_every_rank_once():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([10, 97, 300])
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 30))}
        plan = packing.plan_bins(counts, capacity)
        ranks, room = defaultdict(list), Counter()
        for length, first, n, first_bin, each, offset in plan.tolist():
            ranks[length].append((first, n))
            for b in range(n // each):
                room[first_bin + b] += each * length
            assert n % each == 0 and offset + each * length <= capacity
        for length, parts in ranks.items():
            at = 0
            for first, n in sorted(parts):
                assert first == at
                at += n
            assert at == counts[length]
        assert set(ranks) == set(counts) and all(v <= capacity for v in room.values())
        large = sum(n for length, n in counts.items() if length > capacity // 3)
        assert len(room) >= -(-large // 2)


def test_large_items_pair_before_small_ones_fill():
    bins = packing.match_large(np.bincount([60, 40, 55, 45, 70, 34], minlength=101), 100)
    assert sorted(sorted(x for x, k in b.runs for _ in range(k)) for b in bins) == [[34], [40, 60], [45, 55], [70]]


def test_mixing_follows_targets(spark):
    docs = frame(spark, [(d, "word " * (1 + d % 7)) for d in range(6000)])
    targets = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), ("s2", 0.0), ("gone", 5.0)], "source string, weight double")
    mixed = mixing.mix_sources(docs.where("source is not null"), targets, seed=3).cache()
    size = {r.source: r["sum(length(text))"] for r in mixed.groupBy("source").agg(F.sum(F.length("text"))).collect()}
    assert set(size) == {"s0", "s1"} and abs(size["s0"] / size["s1"] - 3) < 0.2
    assert docs.columns == [c for c in mixed.columns if c not in ("copy", "rate", "mix_key")] + ["copy", "rate"] or set(docs.columns) <= set(mixed.columns)
    copies = [r[1] for r in mixed.where("source = 's0'").groupBy("doc_id").count().collect()]
    rate = mixed.where("source = 's0'").first().rate
    drawn = Counter(copies)
    drawn[0] = 1999 - len(copies)
    for k in range(4):
        expected = 1999 * np.exp(-rate) * rate**k / np.prod(range(1, k + 1))
        assert abs(drawn[k] - expected) < 5 * np.sqrt(expected) + 3
    again = mixing.mix_sources(docs.where("source is not null").repartition(7), targets, seed=3)
    assert again.select("doc_id", "copy").exceptAll(mixed.select("doc_id", "copy")).isEmpty() and again.count() == mixed.count()
    keys = [r.mix_key for r in mixed.select("mix_key").collect()]
    assert keys == sorted(keys)


def test_mixing_by_salted_join_is_the_same(spark, monkeypatch):
    docs = frame(spark, [(d, "w" * (d % 50)) for d in range(500)])
    one = mixing.mix_sources(docs).select("doc_id", "copy").collect()
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert Counter(one) == Counter(mixing.mix_sources(docs).select("doc_id", "copy").collect())


def test_mixing_edges(spark, edge_docs, no_docs):
    mixed = mixing.mix_sources(edge_docs, budget=4000 * 90.0)
    assert mixed.count() > 0 and mixed.where("doc_id = 90").count() % 2 == 0  # rows that repeat an id are drawn alike
    assert mixing.mix_sources(no_docs).count() == 0
    big = frame(spark, [(d, "word") for d in range(300)])
    many = mixing.mix_sources(big.where("source = 's1'"), budget=100 * 4 * 100.0)  # a mean above the table's part
    assert abs(many.count() - 10_000) < 600


def brute_top(vectors, k):
    whole = {i: np.floor(np.array(v, np.float64) * 256) for i, v in vectors}
    out = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_top_k(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 150)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    vectors = [(i, (centres[i % 6] + spread * rng.normal(size=12)).tolist()) for i in range(700)]
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    df = df.select("id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("vector"))
    got = topk.exact_top_k(df, df.where("id % 50 = 0"), 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, int(r.score)) for r in got) == brute_top(vectors, 5)


def test_trees_prune_and_edges(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 100
    points = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 8)))
    search = topk.Search(points[:40], np.arange(40), points, np.arange(4000), 5)
    assert search.scored < 40 * 4000 / 2
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (3, [2.0, 2.0]), (4, [2.0, 2.0]), (4, [2.0, 2.0]), (200, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = topk.exact_top_k(df, df.where("id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 3, 6.0), (0, 2, 4, 6.0)]
    assert topk.exact_top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_queries_meet_few_cells_of_clustered_vectors(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 8)) * 100
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(1600, 8)))
    order = rng.permutation(1600)
    cells = topk.Cells([(int(i), points[i]) for i in order[:800]], 64, 5)
    cell, away = cells.nearest(pa.array(points.tolist()))
    cells.measure({int(c): (float(away[cell == c].max()), 2) for c in np.unique(cell)})
    ids, asked = pa.array(range(0, 1600, 16)), points[::16]
    row, block = map(np.concatenate, zip(*cells.met(ids, pa.array(asked.tolist()))))
    met = set(zip(row.tolist(), (block >> 32).tolist()))
    assert len(row) == 2 * len(met) and len(met) < len(asked) * len(np.unique(cell)) / 3
    scores = asked @ points.T
    scores[np.arange(100), np.arange(0, 1600, 16)] = -np.inf
    for q in range(100):
        least = np.sort(scores[q])[-5]
        assert all((q, int(cell[c])) in met for c in np.flatnonzero(scores[q] >= least))


def test_top_k_of_mixed_lengths_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 3)
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 4)
    rows = [(i, [float(i % 7 - 3)] * (1 + i % 4), i, 1, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, cell long, block long, held string")
    asked = df.where("id % 10 = 0")
    want = []
    for q, v, *_ in rows[::10]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w, *_ in rows if c != q and len(w) == len(v))[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(map(tuple, topk.exact_top_k(df, asked.union(asked), 5).collect())) == sorted(want)


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("least", [0, 20])
def test_archive_round_trip(spark, compress, least):
    long = "<p>" + "é" * 200_000
    rows = [(5, "http://a/x", "<b>same page body</b>"), (2, "http://b/ é\r\ny", "<b>same page body</b>"), (9, None, "<b>same page body</b>"), (1, "u", ""), (3, "u", None), (4, "v", long), (7, "v", "\r\n\r\nWARC/1.1\r\n"), (None, "w", "<b>same page body</b>"), (8, "http://c", "\x00odd")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = f"{ensure_checkpoint_dir(spark)}/warc-test-{random.random()}"
    warc.write_warc(page_records(pages, least), path, compress)
    records = warc.read_warc(spark, path)
    got = {r.id: r for r in records.withColumn("id", page_of("record_id")).withColumn("to", page_of("refers_to")).collect()}
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    assert len(got) == len(rows)
    for i, url, html in rows:
        data = (html or "").encode()
        revisit = i is not None and len(data) >= least and first[html or ""] != i
        r = got[i]
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.payload_digest == plain.sha1_base32(data) and r.payload_length == len(data)
        assert r.payload is None if revisit else bytes(r.payload) == data
        assert r.to == (first[html or ""] if revisit else None)
    revisits = records.where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert "PushedFilters" in revisits._jdf.queryExecution().executedPlan().toString() or revisits.count() <= 1
    assert {r.record_type for r in records.where("record_type = 'revisit'").collect()} <= {"revisit"}
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0


def test_header_filters_reach_the_scan(spark):
    reader = warc.WarcReader("x", True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"x"), warc.GreaterThan(("payload_length",), 5)]))
    assert [f.attribute for f in left] == [("payload",)] and len(reader.filters) == 2


def test_broken_and_empty_archives(spark, tmp_path):
    import io

    with pytest.raises(ValueError):
        warc.parse_head(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.parse_head(io.BytesIO(b"WARC/1.1\r\nWARC-Type: response\r\n"))
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{ensure_checkpoint_dir(spark)}/warc-none-{random.random()}"
    warc.write_warc(page_records(pages), path)
    assert warc.read_warc(spark, path).count() == 0


def test_uncommitted_files_are_not_read(spark):
    path = f"{ensure_checkpoint_dir(spark)}/warc-lost-{random.random()}"
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    warc.write_warc(page_records(pages), path)
    stray = warc.WarcWriter(path, False)
    rows = [{"record_type": "response", "record_id": "urn:x", "target_uri": None, "date": "d", "refers_to": None, "payload": b"z"}]
    import pyarrow as pa

    assert stray.write(iter([pa.RecordBatch.from_pylist(rows)])).file
    assert warc.read_warc(spark, path).count() == 2

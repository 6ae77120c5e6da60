"""Near-duplicates, substring removal, fingerprints: operators that hold documents against each other."""

import random
from collections import Counter

import numpy as np
import plain
import pytest
from corpus_tables import frame, passage
from pyspark.sql import functions as F
from riskpanel.llm import fingerprint as fp
from riskpanel.llm import neardup, substring


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_groups(edge_docs, edges, size, percent):
    want = plain.near_groups(edges, size, percent)
    got = neardup.near_duplicates(edge_docs, size, percent).collect()
    assert len(got) == len(edges)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(plain.shingles(t, size))) for d, t in edges)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept is None for r in got if r.doc_id is None)


def test_chain_of_a_hot_bucket(spark):
    """Near copies that only a chain links, beside others that share buckets with it but no link."""
    rng = random.Random(1)
    words = passage(rng, 120)
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(len(words))] = f"n{k}"
    half = passage(rng, 60)
    rows += [(100 + k, " ".join(half + passage(rng, 25))) for k in range(60)]
    rng.shuffle(rows)
    got = neardup.near_duplicates(frame(spark, rows), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == plain.near_groups(rows, 3, 85)


def test_no_documents(no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    assert substring.remove_repeats(no_docs).count() == 0
    assert fp.fingerprint_edits(no_docs).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    for share in (0.95, 0.85, 0.5):
        a = rng.integers(1, 1 << 63, 2000, dtype=np.uint64)
        n = int(2000 * share)
        union = 2 * 2000 - n
        b = np.concatenate((a[:n], rng.integers(1, 1 << 63, 2000 - n, dtype=np.uint64)))
        sketches = neardup.odd_sketches(np.stack([neardup.samples(np.unique(x)) for x in (a, b)]))
        ones = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        estimate = 1 + neardup.SKETCH_BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * ones / neardup.SKETCH_BITS)
        assert abs(estimate - n / union) < 0.15
        assert (ones <= neardup.most_ones(0.85)) == (n / union > 0.6)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(500)] + [(1000, 1001), (1001, 1002), (999, 1002)], "a long, b long")
    got = {r.node: r.comp for r in neardup.components(edges).collect()}
    assert got == {**{k: 0 for k in range(501)}, **{k: 999 for k in range(999, 1003)}}


@pytest.mark.parametrize("window, anchor", [(50, 32), (20, 7), (5, 3)])
def test_repeats_removed(edge_docs, edges, window, anchor):
    got = [tuple(r) for r in substring.remove_repeats(edge_docs, window, anchor).collect()]
    assert Counter(got) == Counter(plain.without_repeats(edges, window))


def test_repeats_of_few_words(spark):
    """Small alphabets: repeats within documents, overlapping and nested matches."""
    rng = random.Random(6)
    rows = [(d, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for d in range(120)]
    got = [tuple(r) for r in substring.remove_repeats(frame(spark, rows), 6, 4).collect()]
    assert Counter(got) == Counter(plain.without_repeats(rows, 6))


def test_factors_are_greedy():
    words = np.arange(100, dtype=np.uint64) * np.uint64(7919)
    reference = substring.Reference([words[:40], words[60:]], 10)
    spans, open_, _ = reference.parse(np.concatenate((words[5:30], words[60:75])))
    assert spans == [(0, 40)] and list(open_) == list(range(16, 25))


def test_fingerprints_of_edits(edge_docs, edges):
    got = fp.fingerprint_edits(edge_docs).collect()
    assert len(got) == len(edges)
    ids = sorted({d for d, _ in edges if d is not None})
    smallest = {d: min(t or "" for e, t in edges if e == d) for d in ids}
    import hashlib

    want = Counter()
    for d, t in edges:
        t = t or ""
        half = len(t) // 2
        if d is None:
            want[d, len(t), None] += 1
            continue
        after = smallest[ids[(ids.index(d) + 1) % len(ids)]]
        want[d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got if r.doc_id is not None)
    prints = {}
    for r, text in [(r, t) for r in got for d, t in edges if d == r.doc_id and Counter(e for e, _ in edges)[d] == 1]:
        assert prints.setdefault(text or "", r.fingerprint) == r.fingerprint


def test_fingerprint_is_a_multiset_homomorphism(spark):
    text = "First one.\nSecond line here.\nThird! Fourth?\nSecond line here."
    df = spark.createDataFrame([(text, "Third! Second line here.\nFourth?\nFirst one.\nSecond line here.", "Second line here.", "First one.\nSecond line here.\nThird! Fourth?")], "a string, b string, c string, d string")
    a, b, c, d = (fp.fingerprint(F.col(x)) for x in "abcd")
    row = df.select((a == b).alias("order"), (fp.subtract(a, c) == d).alias("less"), (fp.add(d, c) == a).alias("more"), (a == d).alias("count"), fp.likeness(a, d).alias("near"), fp.likeness(a, fp.fingerprint(F.lit(""))).alias("none"), fp.likeness(c, c).alias("same")).first()
    assert row.order and row.less and row.more and not row["count"]
    assert 0.6 < row.near < 1 and row.none == 0 and row.same == 1
    parts = spark.createDataFrame([("First one.\nThird!",), ("Second line here.\nFourth?\nSecond line here.",)], "t string").select(fp.fingerprint(F.col("t")).alias("lanes"))
    total = parts.agg(fp.sum_fingerprints(F.col("lanes")).alias("sum")).first()["sum"]
    assert total == df.select(a.alias("x")).first().x


def test_likeness_follows_the_shared_share(spark):
    rng = random.Random(9)
    lines = [" ".join(passage(rng, 6)) for _ in range(200)]
    rows = [("\n".join(lines[:100]), "\n".join(lines[100 - k : 200 - k]), k / 100) for k in (0, 25, 50, 75, 100)]
    df = spark.createDataFrame(rows, "a string, b string, share double")
    for r in df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("near"), "share").collect():
        assert abs(r.near - r.share) < 0.3

"""Centroid clustering and hard negatives against plain versions on vectors with edge cases."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from riskpanel.llm import centroids, negatives
from riskpanel.session import ship_package

# Extra columns whose names the operators use themselves.
CLASH = ["n", "vector", "cluster", "distance", "lower", "scans", "dim", "block", "kind", "wanted", "rank", "id", "total", "components"]


def embedding_rows(dim: int, seed: int = 3) -> list[tuple]:
    """(vec_id, embedding, label): clusters, ties, repeated ids and vectors, and rows that take no part."""
    rng = random.Random(seed)
    hubs = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for k in range(400):
        hub = hubs[k % 6 if k % 3 else 0]
        rows.append((k, [h + rng.gauss(0, 0.15) for h in hub], k % 4))
    rows += [(500 + k, list(hubs[1]), k % 3) for k in range(20)]  # equal vectors: ties
    rows += [(7, [0.5] * dim, 1), (7, [-0.5] * dim, 2), (None, [0.25] * dim, 0), (None, list(hubs[2]), 1)]
    rows += [(600, None, 1), (601, [], 1), (602, [1.0] * (dim - 1), 1), (603, [None] + [1.0] * (dim - 1), 1)]
    rows += [(604, [math.nan] + [1.0] * (dim - 1), 1), (605, [math.inf] * dim, 1), (606, list(hubs[3]), None), (607, [1e30] * dim, 2)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    ship_package(spark)
    schema = "vec_id bigint, embedding array<double>, label int, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], schema).repartition(3)


def plain_clusters(rows, k, rounds, scale, dim):
    def kept(v):
        return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x * scale) < centroids.MOST for x in v)

    vectors = [(i, tuple(math.floor(scale * x) for x in v)) for i, v, _ in rows if kept(v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)[:k]
    centres = [v for _, v in first]

    def assign():
        found = []
        for i, v in vectors:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            found.append((i, v, d.index(min(d)), min(d)))
        return found

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, c, _ in assign():
            groups[c].append(v)
        for c, members in groups.items():
            centres[c] = tuple(sum(column) // len(members) for column in zip(*members))
    done = assign()
    inertia = Counter()
    for _, _, c, d in done:
        inertia[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), name[c]) for i, _, c, d in done)


@pytest.mark.parametrize("k, rounds, scale, dim", [(16, 3, 64, 8), (5, 6, 16, 3), (1, 2, 64, 2), (1000, 1, 64, 4)])
def test_clusters(spark, k, rounds, scale, dim):
    rows = embedding_rows(dim)
    got = centroids.cluster_centroids(frame(spark, rows), k, rounds, scale, dim)
    assert Counter(tuple(r)[:6] for r in got.collect()) == plain_clusters(rows, k, rounds, scale, dim)


def test_clusters_of_no_vectors(spark):
    assert centroids.cluster_centroids(frame(spark, [])).count() == 0
    assert centroids.cluster_centroids(frame(spark, [(None, [1.0] * 64, 1), (1, None, 1)])).count() == 0


def test_settled_vectors_are_not_scanned_again(spark):
    """Far clusters whose centroids move a little: all but few vectors are scanned once."""
    rng = random.Random(1)
    rows = [(k, [10.0 * (k % 8 == d) + rng.gauss(0, 0.3) for d in range(8)], 0) for k in range(800)]
    scans = [r.scans for r in centroids.cluster_centroids(frame(spark, rows), 16, 5, 64, 8).collect()]
    assert sum(scans) < 0.6 * 6 * len(rows) and min(scans) == 1


def test_loosening_is_a_bound_below_the_drift():
    rng = np.random.default_rng(2)
    tighter = 0
    for _ in range(300):
        dim = int(rng.integers(2, 6))
        before, after = rng.normal(size=(4, dim)) * 3, rng.normal(size=(4, dim)) * 3
        after = before + (after - before) * rng.uniform(0, 0.5)
        radii = rng.uniform(0, 2, 4)
        most = centroids.loosening(before, after, radii)
        drift = np.linalg.norm(after - before, axis=1)
        assert (most <= drift + 1e-9).all()
        tighter += int((most < 0.7 * drift).sum())
        for i in range(4):
            away = rng.normal(size=(500, dim))
            points = before[i] + away / np.linalg.norm(away, axis=1)[:, None] * radii[i] * rng.uniform(0, 1, 500)[:, None] ** 0.2
            gain = np.linalg.norm(points[:, None] - before[None], axis=2) - np.linalg.norm(points[:, None] - after[None], axis=2)
            assert (gain.max(axis=0) <= most[i] + 1e-9).all()
    assert tighter > 1000


def plain_negatives(rows, positives, negatives_, low, high):
    def clean(rows):
        best = {}
        for i, label, v in rows:
            if i is None or label is None or not v or any(x is None for x in v) or len(v) * max(abs(x) for x in v) ** 2 >= negatives.MOST:
                continue
            best[i] = min(best.get(i, (label, v)), (label, v))
        return best

    held, out = clean(rows), []
    for a, (label, v) in held.items():
        if a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in held.items() if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            inside = sorted((t, i) for t, i, other in scored if other != label and -low * s <= -100 * t <= -high * s)
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(inside[:negatives_])]
    return Counter(out)


@pytest.mark.parametrize("block, dim, low", [(8192, 8, 80), (37, 70, 20)])
def test_hard_negatives(spark, monkeypatch, block, dim, low):
    monkeypatch.setattr(negatives, "BLOCK_VECTORS", block)
    rows = [(i, label, None if v is None else [None if x is None or not math.isfinite(x) else math.floor(64 * x) for x in v]) for i, v, label in embedding_rows(dim)]
    rows += [(610, 1, [1 << 40] * dim)]
    rows = [(i, label, v if v is None or max([abs(x) for x in v if x is not None], default=0) < 1 << 62 else [1 << 62] * dim) for i, label, v in rows]
    clash = [c for c in CLASH if c not in ("id", "vector")]
    schema = "id bigint, label int, vector array<bigint>, " + ", ".join(f"`{c}` string" for c in clash)
    ship_package(spark)
    df = spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], schema).repartition(3)
    got = negatives.hard_negatives(df, df.where("id % 10 = 0"), 5, 4, low, 100)
    want = plain_negatives(rows, 5, 4, low, 100)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50
    assert negatives.hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert negatives.hard_negatives(df, df.where("id = 12345")).count() == 0


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for n, inner, m in [(1, 1, 1), (64, 64, 64), (65, 33, 129), (200, 97, 71), (16, 300, 500), (0, 64, 80), (90, 0, 90)]:
        a, b = rng.integers(-(1 << 26), 1 << 26, (n, inner)), rng.integers(-(1 << 26), 1 << 26, (inner, m))
        want = a.astype(object) @ b.astype(object) if n and inner else np.zeros((n, m))
        assert (negatives.strassen(a, b) == want).all()

"""Exact k-means rounds on integer vectors with geometrically tightened drift.

A vector keeps its exact distance to its own centroid and a lower bound on its
distance to every other one. When the centroids move, the lower bound must be
loosened by what another centroid can have come nearer. The full drift would do;
but a cluster's vectors lie in a sphere around the centroid they were assigned
to, and how much nearer a moved centroid can come to a point of a sphere is a
question in the plane through the sphere's centre and the line of the move. For
centroids that move aside or away the answer is far below the drift, often 0. A
vector whose own distance stays below its bound keeps its cluster; the others
are ambiguous and are held against all centroids exactly.

Centroids, cluster sums and radii are the only things the driver sees: one row
per cluster and round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_to_table
from .topk import finite

# Larger components make a vector take no part, so that squared distances fit into 64 bits.
MOST = 1 << 27


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as an integer array."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def within(vector: Column, scale: int, most: int = MOST) -> Column:
    """Whether all components of a finite vector stay below ``most`` when scaled."""
    return ~F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= most)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to all centroids."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, centroid in enumerate(centroids):
        away = vectors - centroid
        out[:, k] = np.einsum("ij,ij->i", away, away)
    return out


def loosening(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """How much nearer centroid ``j`` can have come to any vector of cluster ``i``, per cluster and centroid.

    In the plane of the sphere's centre and the move, with the middle of the
    move as origin, a point's gain is at most the drift times the sine of its
    elevation above the move's bisector. The highest elevation in a sphere is
    that of its centre and the angle under which its radius is seen together.
    """
    before, after = before.astype(float), after.astype(float)
    move = after - before
    drift = np.sqrt((move**2).sum(axis=1))
    ray = before[:, None, :] - (before + after)[None, :, :] / 2.0
    reach = np.sqrt((ray**2).sum(axis=2))
    up = (ray * move[None]).sum(axis=2) / np.where(drift > 0, drift, 1.0)
    across = np.sqrt(np.maximum(reach**2 - up**2, 0.0))
    seen = np.arcsin(np.minimum(radii[:, None] / np.where(reach > 0, reach, 1.0), 1.0))
    angle = np.arctan2(up, across) + seen
    share = np.where(angle >= np.pi / 2, 1.0, np.maximum(np.sin(np.minimum(angle, np.pi / 2)), 0.0))
    return drift * np.where(radii[:, None] >= reach, 1.0, share)


def loosened(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """By how much each cluster's lower bounds fall: the worst over the other centroids."""
    each = loosening(before, after, radii)
    np.fill_diagonal(each, 0.0)
    return each.max(axis=1, initial=0.0) * (1 + 1e-9) + 1e-9


STATE = "vec_id bigint, vector array<bigint>, cluster int, distance bigint, lower double, scans int"


def _assign(rows: DataFrame, centroids: np.ndarray, fall: np.ndarray | None) -> DataFrame:
    """One assignment of all vectors; without ``fall`` nothing is known yet and all are scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, centroids.shape[1]), np.int64)
            if fall is None:
                cluster, scans = np.zeros(n, np.int32), np.zeros(n, np.int32)
                own, lower, open_ = np.zeros(n, np.int64), np.zeros(n), np.arange(n)
            else:
                cluster, scans = (batch.column(k).to_numpy(zero_copy_only=False).copy() for k in (2, 5))
                lower = batch.column(4).to_numpy(zero_copy_only=False) - fall[cluster]
                away = vectors - centroids[cluster]
                own = np.einsum("ij,ij->i", away, away)
                open_ = np.flatnonzero(np.sqrt(own) * (1 + 1e-12) >= lower)
            found = distances(vectors[open_], centroids)
            nearest = found.argmin(axis=1)
            at = np.arange(len(open_))
            cluster[open_], own[open_] = nearest, found[at, nearest]
            others = found.astype(float)
            others[at, nearest] = np.inf
            lower[open_] = np.sqrt(others.min(axis=1, initial=np.inf)) * (1 - 1e-12)
            scans[open_] += 1
            columns = [batch.column(0), batch.column(1), pa.array(cluster), pa.array(own), pa.array(lower), pa.array(scans)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "cluster", "distance", "lower", "scans"])

    return rows.mapInArrow(run, STATE)


def _sums(state: DataFrame, dim: int) -> dict[int, tuple]:
    """Per cluster: count, largest distance, sum of distances, and the sum of every component, all exact."""
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = [F.sum(F.col("vector")[k]).alias(f"s{k}") for k in range(dim)]
    rows = state.groupBy("cluster").agg(
        F.count("*").alias("n"), F.max("distance").alias("far"), exact(F.col("distance")).alias("total"), F.array(*sums).alias("sums")
    )
    return {r["cluster"]: (r["n"], r["far"], int(r["total"]), r["sums"]) for r in rows.collect()}


def cluster_centroids(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans) of (vec_id, embedding) rows.

    A component x counts as floor(scale * x). Vectors that are null, hold a null
    or non-finite component, have another length than ``dim``, or a scaled
    component of ``MOST`` and more take no part and are not returned. Centroids
    start as the ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``,
    in that order; ties go to the smaller vector, and rows without id never
    start one but are clustered. Rows that repeat an id are vectors of their
    own. With fewer vectors than ``k`` there are fewer centroids, and an empty
    table has no rows. Each round assigns every vector to the nearest centroid,
    ties to the smaller number, and replaces each centroid that has vectors by
    their floored mean; then all are assigned once more. ``scans`` is how often
    a vector was held against all centroids, of ``rounds + 1`` assignments.
    """
    kept = vectors.where(finite(F.col("embedding")) & (F.size("embedding") == dim) & within(F.col("embedding"), scale))
    kept = kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole_components(F.col("embedding"), scale).alias("vector"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(name, "vector").limit(k).select("vector").collect()
    if not first:
        empty = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, scans int"
        return vectors.sparkSession.createDataFrame([], empty)
    centroids, fall, state = np.array([r["vector"] for r in first], np.int64), None, kept
    for _ in range(rounds):
        state = cut_to_table(_assign(state, centroids, fall))
        sums = _sums(state, dim)
        moved, radii = centroids.copy(), np.zeros(len(centroids))
        for cluster, (n, far, _, components) in sums.items():
            moved[cluster] = [s // n for s in components]
            radii[cluster] = np.sqrt(far) * (1 + 1e-12)
        fall, centroids = loosened(centroids, moved, radii), moved
    state = cut_to_table(_assign(state, centroids, fall))
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()
    inertia = {r["cluster"]: int(r["total"]) for r in sums}
    long = lambda x: x if x < 1 << 63 else None
    # One row per centroid, k at most.
    named = vectors.sparkSession.createDataFrame(
        [(c, long(total), long(sum(inertia.values())), ",".join(map(str, centroids[c].tolist()))) for c, total in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, components string",
    )
    done = state.join(F.broadcast(named), "cluster")
    return done.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"), "scans"
    )

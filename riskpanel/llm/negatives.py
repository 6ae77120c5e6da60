"""Hard negatives of anchors by exact integer products, multiplied by Strassen's rule.

Candidates are dealt into blocks once. Anchors, which are far fewer, are sent to
every block; there the scores of a batch of anchors and the block are one tile:
a product of integer matrices, computed by Strassen's recursion with zero padding.
Its sums and differences are exact in 64 bits, and even where an intermediate
sum wraps around the result does not. A first walk keeps each anchor's best rows
of its own label, a second one the best rows of other labels inside the window
below each positive. A tile returns only its bounded heaps; heaps of one anchor
from all tiles are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_to_table
from .common import partitions

# Candidates of a block on average: some MB of 64-bit components.
BLOCK_VECTORS = 8192
# Tiles with a side below this are multiplied directly.
LEAF = 16
# A vector takes part if its length times its largest component squared stays below this.
MOST = 1 << 56


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices by seven half-size products; odd sides are padded with zeros."""
    (n, inner), m = a.shape, b.shape[1]
    if min(n, inner, m) < 2 * LEAF:
        return np.einsum("ik,kj->ij", a, b)  # numpy's integer matmul is many times slower
    if (n | inner | m) & 1:
        a = np.pad(a, ((0, n & 1), (0, inner & 1)))
        b = np.pad(b, ((0, inner & 1), (0, m & 1)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    out = np.empty((2 * r, 2 * t), np.int64)
    c11, c12, c21, c22 = out[:r, :t], out[:r, t:], out[r:, :t], out[r:, t:]
    p = strassen(a11 + a22, b11 + b22)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return out[:n, :m]


def first_of_each(group: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of every run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(group)]))))
    return np.flatnonzero(rank < most)


class Block:
    """The candidates of one block, ordered by label and id; of rows that repeat an id the smallest counts."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((*vectors.T[::-1], labels, ids))
        order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))]
        order = order[np.lexsort((ids[order], labels[order]))]
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(vectors[order].T)

    def positives(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: int) -> list[np.ndarray]:
        """Heap of each anchor: (anchor place, candidate id, score) of its best ``most`` others of the same label."""
        out = []
        for label in np.unique(labels):
            lo, hi = np.searchsorted(self.labels, (label, label), "left")[0], np.searchsorted(self.labels, label, "right")
            rows = np.flatnonzero(labels == label)
            if lo == hi:
                continue
            scores = strassen(vectors[rows], self.columns[:, lo:hi])
            found = self.ids[lo:hi]
            # The most-th best score bounds what is sorted; the anchor itself may be among the best.
            keep = min(most + 1, hi - lo)
            least = np.partition(scores, hi - lo - keep, axis=1)[:, hi - lo - keep]
            row, at = np.nonzero((scores >= least[:, None]) & (found[None, :] != ids[rows][:, None]))
            out.append(self._best(rows[row], found[at], scores[row, at], most))
        return [np.concatenate([part[k] for part in out]) if out else np.zeros(0, np.int64) for k in range(3)]

    def negatives(self, labels: np.ndarray, vectors: np.ndarray, wanted: np.ndarray, most: int, low: int, high: int) -> list[np.ndarray]:
        """Heap of each positive (anchor place, score): (place of the positive, candidate id, score) inside its window."""
        place, score = wanted
        scores = strassen(vectors, self.columns)
        floor, top = np.full(len(vectors), np.iinfo(np.int64).max), np.full(len(vectors), np.iinfo(np.int64).min)
        np.minimum.at(floor, place, low * score)
        np.maximum.at(top, place, high * score)
        row, at = np.nonzero((100 * scores >= floor[:, None]) & (100 * scores <= top[:, None]) & (self.labels[None, :] != labels[:, None]))
        value, found = scores[row, at], self.ids[at]
        # Each anchor's rows once per positive; windows of one anchor overlap.
        begins, ends = np.searchsorted(row, place, "left"), np.searchsorted(row, place, "right")
        parts = []
        for p in range(len(place)):
            mine = value[begins[p] : ends[p]]
            inside = np.flatnonzero((low * score[p] <= 100 * mine) & (100 * mine <= high * score[p])) + begins[p]
            parts.append((np.full(len(inside), p), found[inside], value[inside]))
        group, found, value = (np.concatenate([part[k] for part in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        return self._best(group, found, value, most)

    @staticmethod
    def _best(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> list[np.ndarray]:
        order = np.lexsort((ids, -scores, group))
        order = order[first_of_each(group[order], most)]
        return [group[order], ids[order], scores[order]]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _tiles(candidates: DataFrame, anchors: DataFrame, run_tile, schema: str) -> DataFrame:
    """Apply ``run_tile(block, batch of anchors)`` to every block and every batch of anchors of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, block = None, [], None
        for batch in batches:
            dims, blocks, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            edges = np.flatnonzero((dims[1:] != dims[:-1]) | (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if (dims[lo], blocks[lo]) != current:
                    current, parts, block = (dims[lo], blocks[lo]), [], None
                ids, labels = (part.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
                vectors = _matrix(part.column(5), hi - lo)
                if kinds[lo] == 0:
                    parts.append((ids.copy(), labels.copy(), vectors.copy()))
                    continue
                if block is None:
                    if not parts:
                        continue
                    block, parts = Block(*(np.concatenate([p[k] for p in parts]) for k in range(3))), []
                yield from run_tile(block, ids, labels, vectors, part.column(6))

    sizes = candidates.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
    held = candidates.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = anchors.join(sizes, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["dim", "block", "kind", "id", "label", "vector", "wanted"]
    none = F.lit(None).cast("array<struct<id: bigint, score: bigint>>")
    rows = held.withColumns({"kind": F.lit(0), "wanted": none}).select(*columns)
    rows = rows.unionByName(asked.withColumn("kind", F.lit(1)).select(*columns))
    dealt = rows.repartition(partitions(rows), "dim", "block").sortWithinPartitions("dim", "block", "kind", "id")
    return dealt.mapInArrow(run, schema)


def _record(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (id, label, vector) rows.

    ``vector`` holds integers and a score is an inner product. An anchor's
    positives are its first ``positives`` other rows of its label, by score
    downwards and then by id; per positive the first ``negatives`` rows of other
    labels with ``low * positive_score <= 100 * score <= high * positive_score``
    are returned. ``anchors`` are some of the rows. Rows without id, label or
    vector, or with a null component, take no part, nor do vectors whose length
    times their largest component squared reaches ``MOST``. Vectors of different
    length do not meet. Of rows that repeat an id one counts, that with the
    smallest label, then vector. An empty table, an anchor without positives and
    a positive without negatives have no rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.where("id is not null and label is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull()))
        largest = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
        df = df.where((F.size("vector") > 0) & (F.size("vector") * largest * largest < float(MOST)))
        return df.select(F.size("vector").alias("dim"), F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "vector")

    candidates = clean(rows)
    least = F.min(F.struct("label", "vector", "dim")).alias("least")
    asked = cut_to_table(clean(anchors).groupBy("id").agg(least).select("least.dim", "id", "least.label", "least.vector"))

    def best_positives(block, ids, labels, vectors, _) -> Iterator[pa.RecordBatch]:
        place, found, score = block.positives(ids, labels, vectors, positives)
        yield _record(["anchor_id", "id", "score"], [ids[place], found, score])

    none = F.lit(None).cast("array<struct<id: bigint, score: bigint>>")
    found = _tiles(candidates, asked.withColumn("wanted", none), best_positives, "anchor_id bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    wanted = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("wanted"))
    asked = cut_to_table(asked.join(wanted, "id"))

    def best_negatives(block, ids, labels, vectors, lists) -> Iterator[pa.RecordBatch]:
        at = lists.offsets.to_numpy()
        place = np.repeat(np.arange(len(ids)), np.diff(at))
        flat = lists.values.slice(at[0], at[-1] - at[0])
        named, score = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "score"))
        which, found, value = block.negatives(labels, vectors, np.stack([place, score]), negatives, low, high)
        yield _record(
            ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
            [ids[place[which]], named[which], score[which], found, value],
        )

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _tiles(candidates, asked, best_negatives, schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

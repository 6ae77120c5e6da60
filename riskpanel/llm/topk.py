"""Exact top-k inner-product search with two cover trees.

The top level of the candidates' cover tree are pivots: every candidate goes to
the cell of its nearest one, and large cells are split into blocks. A query goes
only to cells whose centre and radius allow a score as high as its k-th best in a
bounded sample of the candidates. Within a block both sides are indexed by cover
trees and the trees are walked together: two nodes are dropped when the largest
inner product their centres and radii allow stays below the worst k-th score of
the node's queries. The best k of every block are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_to_table
from .common import partitions

# Candidates of a block and queries of a group, on average: a few MB a task.
BLOCK_VECTORS = 8192
GROUP_QUERIES = 512
LEAF = 48
# Nodes up to this size are left whole if their children would hold fewer than LEAST_CHILD rows on average.
WHOLE_NODE = 1024
LEAST_CHILD = 8
# Rows of small nodes that are scored together.
SCORED_AT_ONCE = 1024
# Sampled candidates and their components that are broadcast at most (16 MB), and how many of them are pivots at most.
SAMPLE, SAMPLE_COMPONENTS = 4096, 1 << 21
MAX_PIVOTS = 1024
# A child's radius is at most this share of its parent's.
SHRINK = 0.7


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list["Node"] = field(default_factory=list)
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None
    norms: np.ndarray | None = None


def build(points: np.ndarray, rows: np.ndarray) -> Node:
    """Cover tree over some rows: centres are points, farther apart than the radius their node covers."""
    root = Node(rows, points[rows[0]], 0.0)
    stack = [root]
    while stack:
        node = stack.pop()
        away = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1))
        node.radius = float(away.max())
        if len(node.rows) <= LEAF or node.radius == 0.0:
            continue
        cover = node.radius * SHRINK
        left, distance = node.rows, away
        while len(left):
            near = distance <= cover
            centre = node.centre if not node.children else points[left[0]]
            node.children.append(Node(left[near], centre, 0.0))
            left = left[~near]
            if len(left):
                distance = np.sqrt(((points[left] - points[left[0]]) ** 2).sum(axis=1))
            if len(node.rows) <= WHOLE_NODE and len(node.children) * LEAST_CHILD > len(node.rows):
                node.children = []
                break
        if not node.children:
            continue
        stack += node.children
        node.centres = np.stack([c.centre for c in node.children])
        node.norms = np.sqrt((node.centres**2).sum(axis=1))
    return root


def fill_radii(node: Node) -> None:
    stack = [node]
    while stack:
        at = stack.pop()
        if at.children:
            at.radii = np.array([c.radius for c in at.children])
            stack += at.children


def index(points: np.ndarray) -> Node:
    root = build(points, np.arange(len(points)))
    fill_radii(root)
    return root


class Search:
    """Walks a query tree and a candidate tree and keeps each query's k best."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, holds: Node | None = None):
        self.queries, self.query_ids, self.points, self.ids, self.k = queries, query_ids, points, ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.scored = 0
        asks = index(queries)
        holds = holds or index(points)
        # More than any rounding of the bounds, which are compared with exact scores.
        self.slack = 1e-6 * (1.0 + np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) * max(1, queries.shape[1]))
        self.walk(asks, holds)

    def worst(self, q: Node) -> float:
        return float(self.scores[q.rows, -1].min())

    def score(self, q: Node, rows: np.ndarray) -> None:
        """Score rows for the node's queries and merge; ties go to the smaller id."""
        self.scored += len(q.rows) * len(rows)
        scores = self.queries[q.rows] @ self.points[rows].T
        # Only queries that a row can still change are merged.
        hit = np.flatnonzero((scores >= self.scores[q.rows, -1][:, None]).any(axis=1))
        if not len(hit):
            return
        at, scores = q.rows[hit], scores[hit]
        ids = np.broadcast_to(self.ids[rows], scores.shape)
        scores = np.where(ids == self.query_ids[at][:, None], -np.inf, scores)
        scores = np.concatenate((self.scores[at], scores), axis=1)
        ids = np.concatenate((self.found[at], ids), axis=1)
        if scores.shape[1] > 4 * self.k:
            # All that reach the k-th score, ties included; the others are out.
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            row, place = np.nonzero(scores >= least[:, None])
            order = np.lexsort((ids[row, place], -scores[row, place], row))
            row, place = row[order], place[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, place = row[rank < self.k], place[rank < self.k]
            self.scores[at] = scores[row, place].reshape(-1, self.k)
            self.found[at] = ids[row, place].reshape(-1, self.k)
            return
        best = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[at] = np.take_along_axis(scores, best, axis=1)
        self.found[at] = np.take_along_axis(ids, best, axis=1)

    def walk(self, asks: Node, holds: Node) -> None:
        stack = [(asks, holds, np.inf)]
        while stack:
            q, c, bound = stack.pop()
            if bound < self.worst(q):
                continue
            if q.children and (q.radius >= c.radius or not c.children):
                stack += [(child, c, self.bound(child, c)) for child in q.children]
            elif c.children:
                bounds = c.centres @ q.centre + q.radius * c.norms + c.radii * (np.sqrt((q.centre**2).sum()) + q.radius) + self.slack
                order = np.argsort(-bounds)
                # Small children are scored together, best bounds first; larger ones are walked after them.
                rows: list[np.ndarray] = []
                deeper = []
                for j in order:
                    child = c.children[j]
                    if child.children or q.children:
                        deeper.append((q, child, bounds[j]))
                        continue
                    if bounds[j] < self.worst(q):
                        break
                    rows.append(child.rows)
                    if sum(map(len, rows)) >= SCORED_AT_ONCE:
                        self.score(q, np.concatenate(rows))
                        rows = []
                if rows:
                    self.score(q, np.concatenate(rows))
                stack += reversed(deeper)
            else:
                self.score(q, c.rows)

    def bound(self, q: Node, c: Node) -> float:
        """No query of ``q`` has a larger inner product with a point of ``c``."""
        norm_q, norm_c = np.sqrt((q.centre**2).sum()), np.sqrt((c.centre**2).sum())
        return float(q.centre @ c.centre + q.radius * norm_c + c.radius * norm_q + q.radius * c.radius + self.slack)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of (id, vector) rows: each query's k largest inner products.

    Ties go to the smaller id; a query's own id is no candidate; with fewer
    candidates all are returned. Vectors that are null or hold a null or
    non-finite component take no part; vectors of different length do not meet.
    Of rows that repeat an id one counts, that with the smallest vector. Scores
    are exact where the components are integers with products below 2^53.
    """

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("id").isNotNull() & finite(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
        return rows.withColumn("dim", F.size("vector"))

    held, asked = clean(vectors), clean(queries)
    size = held.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n_sample = min(SAMPLE, max(1, SAMPLE_COMPONENTS // max(1, size["dim"] or 1)))
    sample = [(r["id"], np.array(r["vector"], float)) for r in held.orderBy(F.xxhash64("id"), "id").limit(n_sample).collect()]
    cells = Cells(sample, min(MAX_PIVOTS, -(-size["n"] // BLOCK_VECTORS)), k)
    shared = held.sparkSession.sparkContext.broadcast(cells)

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = shared.value.nearest(batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=["id", "vector", "dim", "cell", "away"])

    held = cut_to_table(held.mapInArrow(to_cell, "id bigint, vector array<double>, dim int, cell int, away double"))
    # At most a row per pivot, and one for vectors of a length that no pivot has.
    found = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    cells.measure({r["cell"]: (r["radius"], -(-r["n"] // BLOCK_VECTORS)) for r in found})
    measured = held.sparkSession.sparkContext.broadcast(cells)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in measured.value.met(batch.column(0), batch.column(1)):
                # Few queries at a time, as each leaves once per block.
                yield batch.take(pa.array(row)).append_column("block", pa.array(block))

    parts = F.element_at(F.create_map(*[F.lit(int(x)) for r in found for x in (r["cell"], cells.parts[r["cell"]])]), F.col("cell")) if found else F.lit(1)
    block = (F.col("cell").cast("bigint") * F.lit(1 << 32) + F.pmod(F.xxhash64("id", F.lit(1)), parts)).alias("block")
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    tasks = max(partitions(held), min(10_000, sum(cells.parts.values())))
    held = held.select("id", "vector", "dim", block).repartition(tasks, "dim", "block")
    asked = asked.mapInArrow(to_blocks, "id bigint, vector array<double>, dim int, block bigint").repartition(tasks, "dim", "block")
    asked = asked.withColumn("asks", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups)))
    held = held.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vector")).alias("held"))
    asked = asked.groupBy("dim", "block", "asks").agg(F.collect_list(F.struct("id", "vector")).alias("asked"))
    pairs = held.join(asked.hint("shuffle_merge"), ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, points), (query_ids, queries) = (_matrix(batch.column(c)[i].values) for c in (0, 1))
                # A block's groups come one after the other and share its tree.
                if last is None or len(ids) != len(last[0]) or (ids != last[0]).any() or (points != last[1]).any():
                    last, tree = (ids, points), index(points)
                search = Search(queries, query_ids, points, ids, k, tree)
                row, place = np.nonzero(search.scores > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[row]), pa.array(search.found[row, place]), pa.array(search.scores[row, place])],
                    names=["query_id", "vec_id", "score"],
                )

    found = pairs.select("held", "asked").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class Cells:
    """A bounded sample of candidates, the pivots among them, and what is known of the pivots' cells."""

    def __init__(self, sample: list[tuple[int, np.ndarray]], n_pivots: int, k: int):
        self.k = k
        self.radii: dict[int, float] = {}
        self.parts: dict[int, int] = {}
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim in {len(v) for _, v in sample}:
            at = [i for i, (_, v) in enumerate(sample) if len(v) == dim]
            points = np.stack([sample[i][1] for i in at])
            pivots = [i for i in at if i < n_pivots]
            self.by_dim[dim] = np.array([sample[i][0] for i in at]), points, np.array(pivots, np.int32)

    def nearest(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its distance from the pivot; -1 where no pivot is as long as the vector."""
        cell, away = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
        for dim, at, points in _by_length(vectors):
            _, sample, pivots = self.by_dim.get(dim, (None, None, ()))
            if not len(pivots):
                continue
            centres = sample[: len(pivots)]
            squares = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)
            near = squares.argmin(axis=1)
            cell[at] = pivots[near]
            away[at] = np.sqrt(((points - centres[near]) ** 2).sum(axis=1))
        return cell, away

    def measure(self, cells: dict[int, tuple[float, int]]) -> None:
        self.radii = {c: radius for c, (radius, _) in cells.items()}
        self.parts = {c: parts for c, (_, parts) in cells.items()}

    def met(self, ids: pa.Array, vectors: pa.Array, at_once: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of queries with the blocks that may hold one of their best k."""
        ids = ids.to_numpy(zero_copy_only=False)
        for dim, at, points in _by_length(vectors):
            for low in range(0, len(at), at_once):
                yield self._met(dim, ids, at[low : low + at_once], points[low : low + at_once])

    def _met(self, dim: int, ids: np.ndarray, at: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sample_ids, sample, pivots = self.by_dim.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros(0, np.int32)))
        cells = np.array([c for c in pivots if c in self.parts], np.int64)
        meets = np.ones((len(at), 1 + len(cells)), bool)
        meets[:, 0] = -1 in self.parts
        if len(cells):
            scores = points @ sample.T
            scores[ids[at][:, None] == sample_ids] = -np.inf
            least = np.sort(scores, axis=1)[:, -self.k] if scores.shape[1] >= self.k else np.full(len(at), -np.inf)
            centres = sample[np.searchsorted(pivots, cells)]
            radii = np.array([self.radii[c] for c in cells])
            length = np.sqrt((points**2).sum(axis=1))[:, None]
            # More than any rounding of the bound.
            slack = 1e-6 * (1.0 + length * (np.sqrt((centres**2).sum(axis=1)) + radii))
            meets[:, 1:] = points @ centres.T + length * radii + slack >= least[:, None]
        row, place = np.nonzero(meets)
        cell = np.concatenate(([-1], cells))[place]
        parts = np.array([self.parts[c] for c in cell], np.int64)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(at[row], parts), np.repeat(cell.astype(np.int64), parts) * (1 << 32) + part


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of the vectors of each length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    return ids, rows.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

"""Rows for boosting: feature values as bins, equal rows once with their number, in blocks of arrays.

A cut of a feature only needs sums per bin. Cut points come from mergeable
aggregates: all middles between the values of a feature with few values,
quantiles otherwise. Rows are then reduced to distinct (bins, label, fold) with
their number; boosting gives equal rows equal weights, so nothing is lost. A
histogram over the blocks is one Spark job whose tasks return sums only.

Where all distinct rows fit one block, a fit runs its rounds inside one task
instead of one job a round; fits of several folds or settings run beside each
other. Both ways do the same arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir, run_parallel, ship_package

# Values (rows times features) of a block, 16 MB; fits on no more distinct rows run inside one task.
BLOCK_VALUES = 1 << 22
# Bins of a feature; a bin is one byte.
MAX_BINS = 256
# Error of the quantiles of features with more values than bins, as a share of the rows: 1 / this.
QUANTILE_ACCURACY = 10_000


@dataclass
class Block:
    """Distinct rows by label: ``keys[i, f]`` is ``f * n_bins + bin``; ``score`` is what a fit adds to a row."""

    keys: np.ndarray
    label: np.ndarray
    count: np.ndarray
    fold: np.ndarray
    score: np.ndarray | None = None

    def by_label(self) -> list[slice]:
        """Rows of label 0 and of label 1."""
        edge = int(np.searchsorted(self.label, 1))
        return [slice(0, edge), slice(edge, len(self.label))]

    def before(self, fold: int | None) -> Block:
        """The rows that train a fold; all without one."""
        if fold is None:
            return self
        rows = self.fold < fold
        return Block(self.keys[rows], self.label[rows], self.count[rows], self.fold[rows])


def cut_points(rows: DataFrame, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending thresholds per feature of rows with an array ``x``: a value belongs left of those it does not exceed."""
    first = rows.select(F.size("x").alias("n")).first()
    n = first["n"] if first else 0
    if not n:
        return []
    kinds = rows.agg(*[F.approx_count_distinct(F.col("x")[f]).alias(f"k{f}") for f in range(n)]).first()
    maybe = [f for f in range(n) if kinds[f"k{f}"] <= 2 * max_bins]
    values: dict[int, list[float]] = {}
    if maybe:
        # At most a few hundred values per feature, by the estimate's error.
        pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col("x")[f].alias("v")) for f in maybe])
        for row in rows.select(F.explode(pairs).alias("p")).select("p.*").distinct().collect():
            values.setdefault(row["f"], []).append(row["v"])
    few = {f: np.sort(v) for f, v in values.items() if len(v) <= max_bins}
    many = [f for f in range(n) if f not in few]
    shares = [k / max_bins for k in range(1, max_bins)]
    found = rows.agg(*[F.percentile_approx(F.col("x")[f], shares, QUANTILE_ACCURACY).alias(f"q{f}") for f in many]).first() if many else None
    return [(few[f][1:] + few[f][:-1]) / 2 if f in few else np.unique(found[f"q{f}"]) for f in range(n)]


@dataclass
class Binned:
    """Blocks of rows with the cut points they were made by."""

    cuts: list[np.ndarray]
    n_bins: int
    rows: int
    blocks: RDD
    n_blocks: int

    @property
    def n_features(self) -> int:
        return len(self.cuts)

    def release(self) -> None:
        self.blocks.unpersist()

    def total(self, job: Callable[[Block], np.ndarray]) -> np.ndarray:
        """Sum of an array over all blocks: one job."""
        return sum_blocks(self.blocks, job)

    def each(self, fits: Sequence, run: Callable) -> list:
        """``run(fit, histogram source)`` of every fit; inside a task per fit where there is one block."""
        if self.n_blocks > 1:
            return run_parallel(lambda fit: run(fit, self), fits, 4)
        context = self.blocks.context
        block = self.blocks.collect()[0] if self.n_blocks else None  # one block at most, of bounded size
        if block is None:
            return [run(fit, self) for fit in fits]
        shared = context.broadcast(block)
        n_bins, cuts = self.n_bins, self.cuts
        work = lambda fit: run(fit, OneBlock(cuts, n_bins, shared.value))
        return context.parallelize(list(fits), len(fits)).map(work).collect()


class OneBlock:
    """The same sums over a block that the task holds."""

    def __init__(self, cuts: list[np.ndarray], n_bins: int, block: Block):
        self.cuts, self.n_bins, self.block, self.n_blocks = cuts, n_bins, block, 1

    @property
    def n_features(self) -> int:
        return len(self.cuts)


def sum_blocks(blocks: RDD, job: Callable[[Block], np.ndarray]) -> np.ndarray:
    def run(part: Iterator[Block]) -> Iterator[np.ndarray]:
        total = None
        for block in part:
            found = job(block)
            total = found if total is None else total + found
        if total is not None:
            yield total

    return sum(blocks.mapPartitions(run).collect())


def bins_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value of a matrix: the number of thresholds it exceeds."""
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros(x.shape, np.int64)


def matrix(column: pa.Array, n: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, width)


def bin_rows(df: DataFrame, fold: str | None = None, max_bins: int = MAX_BINS) -> Binned:
    """Binned rows of (features, label) vectors, by the column ``fold`` if named."""
    if not 2 <= max_bins <= MAX_BINS:
        raise ValueError(f"a bin is one byte: between 2 and {MAX_BINS} bins")
    ship_package(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    where = F.col(fold).cast("int") if fold else F.lit(0)
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"), where.alias("fold"))
    cuts = cut_points(rows, max_bins)
    n, n_bins = len(cuts), max([len(c) for c in cuts], default=0) + 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bins_of(matrix(batch.column(0), batch.num_rows, n), cuts).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), *batch.columns[1:]], names=["bins", "label", "fold"])

    distinct = rows.mapInArrow(assign, "bins binary, label int, fold int").groupBy("bins", "label", "fold").agg(F.count("*").alias("n"))
    distinct = distinct.persist(StorageLevel.MEMORY_AND_DISK)
    size = distinct.agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).first()
    n_blocks = -(-size["kinds"] * n // BLOCK_VALUES)

    def pack(part) -> Iterator[Block]:
        rows = sorted(part, key=lambda r: (r["label"], r["bins"], r["fold"]))
        if not rows:
            return
        bins = np.frombuffer(b"".join(bytes(r["bins"]) for r in rows), np.uint8).reshape(len(rows), n)
        keys = (bins.astype(np.int32) + np.arange(n, dtype=np.int32) * n_bins).astype(np.int32)
        label, count, fold = (np.array([r[c] for r in rows]) for c in ("label", "n", "fold"))
        yield Block(keys, label.astype(np.int8), count.astype(float), fold.astype(np.int32))

    blocks = distinct.repartition(max(1, n_blocks), "bins", "label", "fold")
    blocks = blocks.rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)
    blocks.count()
    distinct.unpersist()
    return Binned(cuts, n_bins, size["rows"] or 0, blocks, n_blocks)


def confusion(block: Block, fold: int, tables: np.ndarray) -> np.ndarray:
    """Counts [stage, label, said] of a fold's test rows under additive score tables [stage, key]; above 0 says 1."""
    rows = block.fold == fold
    keys, label, count = block.keys[rows], block.label[rows], block.count[rows]
    out = np.zeros((len(tables), 2, 2))
    for stage, table in enumerate(tables):
        said = (table[keys].sum(axis=1) > 0).astype(np.int64)
        out[stage] = np.bincount(2 * label + said, weights=count, minlength=4).reshape(2, 2)
    return out


def macro_recall(cells: np.ndarray) -> float | None:
    """Mean recall over the labels that are true or said anywhere, from counts [label, said]."""
    present = [k for k in (0, 1) if cells[k].sum() + cells[:, k].sum() > 0]
    if not present:
        return None
    return float(sum(cells[k, k] / cells[k].sum() if cells[k].sum() else 0.0 for k in present) / len(present))

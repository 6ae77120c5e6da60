"""Best-fit packing of token sequences by large-item matching.

Only lengths decide a packing, and there are at most ``capacity`` of them, so
the plan is made on the histogram: lengths above a third of the capacity are
matched greedily, at most two per bin; smaller ones go to the smallest gap that
holds them. The plan says which ranks of which length go to which bins; Spark
ranks the pieces within their length and looks the place up.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from ..session import cut_lineage
from .common import CACHES, partitions, text_bytes, with_text
from .token_count import Splitter, byte_letters

PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass
class Bins:
    """``count`` equal bins; ``runs`` are (length, items of it per bin) in order of place."""

    count: int
    gap: int
    runs: list[tuple[int, int]]


def match_large(counts: np.ndarray, capacity: int) -> list[Bins]:
    """Bins of one or two lengths above a third: each takes the longest partner that still fits."""
    bins = []
    least = capacity // 3 + 1
    for length in range(capacity, least - 1, -1):
        partner = min(length, capacity - length)
        while counts[length] and partner >= least:
            if partner == length:
                n = int(counts[length]) // 2
                pair = [(length, 2)]
                counts[length] -= 2 * n
            else:
                n = int(min(counts[length], counts[partner]))
                pair = [(length, 1), (partner, 1)]
                counts[length] -= n
                counts[partner] -= n
            if n:
                bins.append(Bins(n, capacity - length - partner, pair))
            partner -= 1
        if counts[length]:
            bins.append(Bins(int(counts[length]), capacity - length, [(length, 1)]))
            counts[length] = 0
    return bins


def best_fit(counts: np.ndarray, bins: list[Bins], capacity: int) -> list[Bins]:
    """Put the remaining lengths, longest first, into the smallest gaps; open bins when none holds one."""
    by_gap: dict[int, list[Bins]] = {}
    for b in bins:
        by_gap.setdefault(b.gap, []).append(b)

    def put(b: Bins, n: int, length: int, each: int) -> None:
        gap = b.gap - length * each
        by_gap.setdefault(gap, []).append(Bins(n, gap, [*b.runs, (length, each)]))

    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g, group in by_gap.items() if g >= length and group), default=None)
            b = by_gap[gap].pop() if gap is not None else Bins(-(-left // (capacity // length)), capacity, [])
            each = b.gap // length  # a bin just filled is the tightest again
            full = min(b.count, left // each)
            if full:
                put(b, full, length, each)
                left -= full * each
            rest = b.count - full
            if rest and left and left < each:
                put(b, 1, length, left)
                left, rest = 0, rest - 1
            if rest:
                by_gap.setdefault(b.gap, []).append(Bins(rest, b.gap, b.runs))
    return [b for group in by_gap.values() for b in group]


def plan_bins(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks, first bin, items per bin, offset), sorted by length and rank."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bins = best_fit(counts, match_large(counts, capacity), capacity)
    used: dict[int, int] = {}
    rows, first_bin = [], 0
    for b in bins:
        offset = 0
        for length, each in b.runs:
            rows.append((length, used.get(length, 0), b.count * each, first_bin, each, offset))
            used[length] = used.get(length, 0) + b.count * each
            offset += length * each
        first_bin += b.count
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def rank_within(df: DataFrame, key: str, order: list[str], spread: int) -> DataFrame:
    """Add ``rank``, from 0 within ``key``; a hot key is split into ``spread`` parts by the order columns."""
    part = F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int")
    df = df.withColumn("part", part)
    sizes = df.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(key, "part").orderBy(*order)
    ranked = df.withColumn("within", F.row_number().over(within))
    return (
        ranked.join(sizes, [key, "part"])
        .withColumn("rank", F.col("before") + F.col("within") - 1)
        .drop("part", "before", "within")
    )


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length`` from 1 to ``capacity``.

    ``order`` names columns that tell the rows apart. Rows that agree in all of
    them are alike and take neighbouring places. No rows: no rows.
    """
    pieces = cut_lineage(pieces)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    plan = plan_bins(histogram, capacity)
    spread = max(64, 4 * partitions(pieces))
    ranked = rank_within(pieces, "length", order, spread)
    length, first, _, first_bin, each, offset = plan.T
    keys = (length << 44) + first
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, (size << 44) + rank, "right") - 1
            bin_, slot = np.divmod(rank - first[run], each[run])
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first_bin[run] + bin_), pa.array(offset[run] + slot * size)],
                names=[*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


# Pieces and words whose ids a Python worker remembers, twice as many at most: some 250 MB.
REMEMBERED_WORDS = 400_000


class Encoder(Splitter):
    """Token ids as little-endian bytes: words are encoded by the tokenizer and remembered."""

    join = staticmethod(b"".join)

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED_WORDS):
        super().__init__(vocabulary, remembered)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

        self.model = self.tokenizer.model  # words are normalised and split already
        self.letters = byte_letters()

    def word_value(self, word: str) -> bytes:
        tokens = self.model.tokenize("".join([self.letters[b] for b in word.encode()]))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def special_value(self, text: str) -> bytes:
        return np.array([self.tokenizer.token_to_id(text)], "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        return b"".join(self.pieces(text))


@functools.lru_cache(2)
def encoder_of(vocabulary: str, remembered: int = REMEMBERED_WORDS) -> Encoder:
    """One encoder per Python worker, kept between its tasks."""
    return Encoder(vocabulary, remembered)


CACHES.append(encoder_of.cache_clear)


def cut_pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, id_column: str = "doc_id", remembered: int = REMEMBERED_WORDS
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): every document's ids and the end id, cut only beyond ``capacity``.

    A null or empty text is the end id alone. Repeated rows give repeated pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, remembered)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    key = docs.schema[id_column].dataType.simpleString()
    return with_text(docs, id_column).mapInArrow(run, f"id {key}, {PIECE}").withColumnRenamed("id", id_column)


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", remembered: int = REMEMBERED_WORDS
) -> DataFrame:
    """Pieces of all documents with the sequence and offset they are packed at; a worker remembers the ids of so many words."""
    pieces = cut_pieces(docs, vocabulary, capacity, end_id, id_column, remembered)
    return pack(pieces, capacity, [id_column, "piece", "start", "ids_crc32"])


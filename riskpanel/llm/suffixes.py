"""Removal of byte strings that occur more than once, by column-wise construction over many documents.

Every window of bytes names an anchor, the leftmost smallest hash of its byte
groups; consecutive windows with one anchor form a segment. Equal windows have
equal anchors at equal offsets, so a window's copies are all in segments of its
anchor, and in segments laid side by side on their anchors they start in the same
column. Spark groups segments by anchor and keeps each distinct one once with
its number of occurrences.

A bucket of anchors is then built column by column from the right, one symbol
per segment a round: the symbols in the order of the suffixes behind them are the
column of the Burrows-Wheeler transform, a stable distribution of that column by
symbol gives the order of the suffixes one symbol longer, and the common prefix
of neighbours grows by one over the least of the prefixes between them. Suffixes
of different columns are never compared, so a round reads the previous column's
two files, order and common prefixes, in sequence, and writes two new ones. They
are of bounded size and stay in the task's memory, as tasks have no shared files
of their own. A window whose common prefix with a neighbour is as long as itself
occurs elsewhere.

An anchor with very many distinct segments is split: by the offset of the anchor
in the window, and by the bytes that all windows of such a range share. The last
split is the window itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_to_table
from .common import _BASE, _BASE_INVERSE, _BYTES, BLOCK_BYTES, _power_table, mix, partitions, text_bytes
from .substring import sliding_min

# Bytes of an anchor group.
GRAM = 32
# Distinct segments of one anchor that a task builds together; more are split.
GROUP_SEGMENTS = 16_384
# Ranges of anchor offsets by which such anchors are split, one after the other.
SPLITS = (16, 1)
# Bytes of segments that a task builds together.
BUCKET_BYTES = 2 << 20
# A segment with more occurrences than this and than a 2^-16 share of all is joined by broadcast, 65,536 of them at most.
HOT_ROWS, HOT_SHARE = 1024, 16


def _blocks(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bytes]]:
    """Yield (places of the texts, their bounds, bytes before it, data): short texts together, a long one in overlapping parts."""
    first = 0
    while first < len(texts):
        if len(texts[first]) > BLOCK_BYTES:
            text = texts[first]
            for at in range(0, len(text) - window + 1, BLOCK_BYTES):
                part = text[at : at + BLOCK_BYTES + window - 1]
                yield np.array([first]), np.array([0, len(part)]), at, part
            first += 1
            continue
        stop, size = first, 0
        while stop < len(texts) and size + len(texts[stop]) <= BLOCK_BYTES:
            size += len(texts[stop])
            stop += 1
        stop = max(stop, first + 1)
        yield np.arange(first, stop), np.cumsum([0, *map(len, texts[first:stop])]), 0, b"".join(texts[first:stop])
        first = stop


def anchored(data: bytes, bounds: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """Segments of texts between the bounds: text, first window, number of windows, offset of the anchor, anchor, hash."""
    values = np.frombuffer(data, np.uint8)
    n = len(values)
    if n < window:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[values] * _power_table("up", _BASE, n), out=sums[1:])
    down = _power_table("down", _BASE_INVERSE, n)
    grams = mix((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
    width = window - gram + 1
    least = sliding_min(grams, width)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + window <= bounds[1:][text])
    hit = grams[: len(least)] == least
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | hit[:-1] | (text[1:] != text[:-1])
    begins = np.flatnonzero(new[valid])
    first = valid[begins]
    last = valid[np.append(begins[1:], len(valid)) - 1] if len(begins) else first
    # The anchor starts with the run's last window, or is the first smallest group in it.
    anchor = least[first]
    place = last.copy()
    for at in range(0, len(last), 8192):
        part = last[at : at + 8192]
        inside = grams[part[:, None] + np.arange(width)] == anchor[at : at + 8192, None]
        place[at : at + 8192] += inside.argmax(axis=1)
    name = mix((sums[last + window] - sums[first]) * down[first])
    return [text[first], first - bounds[:-1][text[first]], last - first + 1, place - first, anchor, name]


def _segments_of(texts: list[bytes], window: int, gram: int) -> Iterator[list[np.ndarray]]:
    """The same for whole texts of any length, in blocks; texts by their place, windows by their place in the text."""
    for places, bounds, before, data in _blocks(texts, window):
        found = anchored(data, bounds, window, gram)
        if len(found[0]):
            found[0] = places[found[0]]
            found[1] = found[1] + before
            yield found


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (doc, row, anchor, seg, n): the distinct segments of each document and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for text, _, _, _, anchor, name in _segments_of(text_bytes(batch.column(2)), window, gram):
                order = np.lexsort((name, text))
                text, anchor, name = text[order], anchor[order], name[order]
                new = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (text[1:] != text[:-1]))))
                count = np.diff(np.append(new, len(name)))
                columns = [docs[text[new]], rows[text[new]], anchor[new], name[new], count]
                yield pa.RecordBatch.from_arrays([_long(c) for c in columns], names=["doc", "row", "anchor", "seg", "n"])

    return docs.select("doc", "row", "text").mapInArrow(run, "doc bigint, row bigint, anchor bigint, seg bigint, n bigint")


SEGMENT = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("data", pa.binary())])
SEGMENT_SQL = "anchor bigint, seg bigint, n bigint, at int, data binary"


def _mixed(place: np.ndarray, name: np.ndarray) -> np.ndarray:
    """One key of a text's place in the batch and a segment's hash."""
    return mix(name ^ mix(place.astype(np.uint64) + np.uint64(1)))


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Place of every entry of a list column, and the entries."""
    at = lists.offsets.to_numpy()
    counts = np.diff(at)
    return np.repeat(np.arange(len(counts)), counts), lists.values.slice(at[0], at[-1] - at[0])


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and numbers of a binary column of 32-bit numbers."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.int32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    return at, np.frombuffer(data, np.int32) if data is not None else np.zeros(0, np.int32)


def _bytes_of(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The wanted segments of documents (doc, row, text, wanted) with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(0))
            place, flat = _flat(batch.column(1))
            names = flat.field("seg").to_numpy(zero_copy_only=False).view(np.uint64)
            counts = flat.field("n").to_numpy(zero_copy_only=False)
            keys = _mixed(place, names)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            for text, first, windows, at, anchor, name in _segments_of(texts, window, gram):
                mine = _mixed(text, name)
                slot = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                found = np.flatnonzero(keys[slot] == mine)
                found = found[np.unique(mine[found], return_index=True)[1]]
                for k in range(0, len(found), 8192):
                    part = found[k : k + 8192]
                    data = [texts[t][a : a + w + window - 1] for t, a, w in zip(text[part].tolist(), first[part].tolist(), windows[part].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [_long(anchor[part]), _long(name[part]), pa.array(counts[slot[part]]), pa.array(at[part].astype(np.int32)), pa.array(data, pa.binary())],
                        schema=SEGMENT,
                    )

    return docs.select("text", "wanted").mapInArrow(run, SEGMENT_SQL)


class Columns:
    """Segments laid side by side on their anchors and built from the right, one column of symbols a round."""

    def __init__(self, segments: list[bytes], at: np.ndarray, window: int):
        self.window = window
        length = np.array([len(s) for s in segments])
        left = int(at.max())
        self.start, self.end = left - at, left - at + length
        self.symbols = np.zeros((int(self.end.max()), len(segments)), np.uint8)
        for lo in range(0, len(segments), 2048):
            hi = min(lo + 2048, len(segments))
            row = np.repeat(np.arange(lo, hi), length[lo:hi])
            begins = np.cumsum(length[lo:hi]) - length[lo:hi]
            column = np.arange(len(row)) + np.repeat(self.start[lo:hi] - begins, length[lo:hi])
            self.symbols[column, row] = np.frombuffer(b"".join(segments[lo:hi]), np.uint8)
        # Which window of which segment starts elsewhere too, by column and segment.
        self.repeated = np.zeros(self.symbols.shape, bool)
        by_end = np.argsort(self.end, kind="stable")
        cuts = np.searchsorted(self.end[by_end], np.arange(len(self.symbols) + 2))
        starts_at = np.zeros(len(self.symbols), bool)
        starts_at[self.start] = True
        order, common = np.zeros(0, np.int64), np.zeros(0, np.uint16)
        for column in range(len(self.symbols) - 1, -1, -1):
            begin = by_end[cuts[column + 1] : cuts[column + 2]]
            order, common = self._insert(column, begin, order, common)
            if starts_at[column]:
                order, common = self._finish(self.start[order] != column, order, common)

    def _insert(self, column: int, begin: np.ndarray, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round: segments that end here join as empty suffixes, then every suffix grows by its symbol."""
        if len(begin):
            order = np.concatenate((begin, order))
            common = np.concatenate((np.zeros(len(begin), np.uint16), common))
        transform = self.symbols[column][order]
        place = np.argsort(transform, kind="stable")
        symbol = transform[place]
        longer = np.zeros(len(place), np.uint16)
        if len(place) > 1:
            # From a suffix to the next with its symbol: the least common prefix of the suffixes between.
            between = np.minimum.reduceat(np.append(common, np.uint16(0)), place + 1)[:-1]
            longer[1:] = np.where(symbol[1:] == symbol[:-1], np.minimum(between, self.window - 1) + 1, 0)
        order = order[place]
        whole = longer >= self.window
        if whole.any():
            whole[:-1] |= whole[1:]
            self.repeated[column, order[whole]] = True
        return order, longer

    @staticmethod
    def _finish(stay: np.ndarray, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leave out the segments that begin here; what their neighbours share is the least of the prefixes between."""
        kept = np.flatnonzero(stay)
        if not len(kept):
            return order[:0], common[:0]
        return order[kept], np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1)))

    def windows(self, k: int) -> np.ndarray:
        """Which windows of a segment start elsewhere too."""
        return self.repeated[self.start[k] : self.end[k] - self.window + 1, k]


def _ranges(flags: np.ndarray) -> bytes:
    """First and last + 1 of every run of true values, as 32-bit numbers."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).astype(np.int32).tobytes()


FOUND = "anchor bigint, seg bigint, n bigint, spans binary"


def _build(segments: DataFrame, window: int) -> DataFrame:
    """Rows (anchor, seg, n, spans) of the segments with windows that start elsewhere; spans are ranges of windows."""

    def built(rows: list[tuple]) -> pa.RecordBatch:
        columns = Columns([r[4] for r in rows], np.array([r[3] for r in rows]), window)
        out = []
        for k, (anchor, name, n, _, data) in enumerate(rows):
            spans = _ranges(columns.windows(k)) if n == 1 else np.array([0, len(data) - window + 1], np.int32).tobytes()
            if spans:
                out.append((anchor, name, n, spans))
        lists = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in lists[:3]], pa.array(lists[3], pa.binary())], names=["anchor", "seg", "n", "spans"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, (None, None)
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if row[:2] == last:  # repeated rows bring their segments again
                    continue
                if size > BUCKET_BYTES and row[0] != last[0]:
                    yield built(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[:2]
        if rows:
            yield built(rows)

    dealt = segments.repartition(partitions(segments), "anchor").sortWithinPartitions("anchor", "seg")
    return dealt.mapInArrow(run, FOUND)


def _split(segments: DataFrame, window: int, width: int) -> DataFrame:
    """Parts of segments by ranges of the anchor's offset, under a key of the bytes that all windows of a range share."""
    names = ["anchor0", "seg0", "n0", "first", "anchor", "seg", "at", "data"]

    def digest(*parts: bytes) -> int:
        held = hashlib.blake2b(digest_size=8)
        for part in parts:
            held.update(part)
        return int.from_bytes(held.digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for anchor, name, n, at, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                first, windows = 0, len(data) - window + 1
                while first < windows:
                    level = (at - first) // width
                    stop = min(windows, at - level * width + 1)
                    core = at - level * width
                    core = data[core : core - width + 1 + window]
                    part = data[first : stop - 1 + window]
                    key = digest(core, level.to_bytes(4, "little"), width.to_bytes(4, "little"))
                    out.append((anchor, name, n, first, key, digest(part, (at - first).to_bytes(4, "little")), at - first, part))
                    size += len(part)
                    first = stop
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    schema = "anchor0 bigint, seg0 bigint, n0 bigint, first bigint, anchor bigint, seg bigint, at bigint, data binary"
    return segments.select("anchor", "seg", "n", "at", "data").mapInArrow(run, schema)


def _settle(segments: DataFrame, window: int, splits: tuple[int, ...]) -> DataFrame:
    """Rows (anchor, seg, n, spans) of distinct segments with ``kinds``, the number of their anchor's."""
    columns = ["anchor", "seg", "n", "at", "data"]
    hot = segments.where(F.col("kinds") > GROUP_SEGMENTS)
    if not splits or hot.isEmpty():
        return _build(segments.select(*columns), window)
    parts = cut_to_table(_split(hot, window, splits[0]))
    pieces = parts.groupBy("anchor", "seg").agg(F.sum("n0").alias("n"), F.min("at").cast("int").alias("at"), F.min("data").alias("data"))
    kinds = parts.select("anchor", "seg").distinct().groupBy("anchor").agg(F.count("*").alias("kinds"))
    found = _settle(cut_to_table(pieces.join(kinds, "anchor")), window, splits[1:]).drop("n")
    back = parts.select("anchor0", "seg0", "n0", "first", "anchor", "seg").join(found, ["anchor", "seg"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = [(np.frombuffer(s, np.int32) + f).astype(np.int32).tobytes() for f, s in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(moved, pa.binary())], names=["anchor", "seg", "n", "spans"])

    moved = back.select("anchor0", "seg0", "n0", "first", "spans").mapInArrow(shift, FOUND)
    joined = F.aggregate(F.collect_list("spans"), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    moved = moved.groupBy("anchor", "seg").agg(F.max("n").alias("n"), joined.alias("spans"))
    return _build(segments.where(F.col("kinds") <= GROUP_SEGMENTS).select(*columns), window).unionByName(moved)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc, row, doc_id, text): rows that share the first two have the same text, and so the same repeats."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("row"), "doc_id", text.alias("text"))


def repeated_segments(docs: DataFrame, window: int = 200, gram: int = GRAM) -> DataFrame:
    """Rows (doc, row, found): per document the segments that hold repeated windows, with these as ranges."""
    keyed = _keyed(docs)
    occurrences = cut_to_table(_occurrences(keyed, window, gram))
    distinct = occurrences.groupBy("anchor", "seg").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "row")).alias("from"))
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1").drop("total")
    shared = cut_to_table(distinct.join(sizes, "anchor"))
    wanted = shared.groupBy("from.doc", "from.row").agg(F.collect_list(F.struct("seg", "n")).alias("wanted"))
    segments = _bytes_of(keyed.join(wanted, ["doc", "row"]), window, gram)
    largest = shared.agg(F.max("kinds").alias("kinds"), F.sum("n").alias("n")).first()
    if (largest["kinds"] or 0) > GROUP_SEGMENTS:
        segments = cut_to_table(segments.join(shared.select("anchor", "seg", "kinds"), ["anchor", "seg"]))
        found = _settle(segments, window, SPLITS)
    else:
        found = _build(segments, window)
    found = cut_to_table(found)
    # Occurrences of hot segments meet a broadcast of bounded size and stay where they are.
    most = max(HOT_ROWS, (largest["n"] or 0) >> HOT_SHARE)
    hot = found.where(F.col("n") > most).select("anchor", "seg", "spans", F.lit(True).alias("hot"))
    marked = occurrences.drop("n").join(F.broadcast(hot), ["anchor", "seg"], "left")
    rest = marked.where("hot is null").drop("hot", "spans").join(found.where(F.col("n") <= most).select("anchor", "seg", "spans"), ["anchor", "seg"])
    both = marked.where("hot").drop("hot").unionByName(rest)
    return both.groupBy("doc", "row").agg(F.collect_list(F.struct("seg", "spans")).alias("found"))


def remove_repeated_bytes(docs: DataFrame, window: int = 200, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept), one per input row.

    Every byte covered by a ``window`` byte string that also starts anywhere
    else, in the same or another row, is removed; ``kept`` is the rest, which may
    cut UTF-8 characters. All copies go. A null or empty text has no bytes, a
    text shorter than a window loses none. Rows are documents of their own, also
    where they repeat an id or have none.
    """
    found = repeated_segments(docs, window, gram)
    placed = _keyed(docs).join(found, ["doc", "row"], "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            place, flat = _flat(batch.column(2))
            keys = _mixed(place, flat.field("seg").to_numpy(zero_copy_only=False).view(np.uint64))
            at, ranges = _binary(flat.field("spans"))
            order = np.argsort(keys)
            keys = keys[order]
            # How many repeated windows begin to cover at a byte, less those that cease to, texts one after the other.
            base = np.cumsum([0, *(len(t) + 1 for t in texts)])
            change = np.zeros(base[-1] + 1, np.int32)
            listed = np.zeros(len(texts), bool)
            listed[place] = True
            touched = [t if x else b"" for t, x in zip(texts, listed)]
            for text, first, _, _, _, name in _segments_of(touched, window, gram) if len(keys) else ():
                mine = _mixed(text, name)
                slot = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                hit = np.flatnonzero(keys[slot] == mine)
                which = order[slot[hit]]
                n = at[which + 1] - at[which]
                entry = np.repeat(at[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
                places = ranges[entry] + np.repeat(base[text[hit]] + first[hit], n)
                np.add.at(change, places[::2], 1)
                np.subtract.at(change, places[1::2] + (window - 1), 1)
            gone_all = np.cumsum(change) > 0
            removed, n_spans, kept = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), list(texts)
            for p in np.flatnonzero(listed).tolist():
                gone = gone_all[base[p] : base[p + 1] - 1]
                removed[p] = gone.sum()
                n_spans[p] = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                kept[p] = np.frombuffer(texts[p], np.uint8)[~gone].tobytes()
            size = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(removed), pa.array(n_spans), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

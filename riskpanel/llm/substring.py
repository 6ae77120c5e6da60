"""Removal of passages that an earlier document already has, by relative Lempel-Ziv parsing.

Every window of words names an anchor, the smallest hash of its word groups, so
equal windows name equal anchors. The document with the smallest id that names
an anchor is its reference. References are indexed block by block and each
document is factored greedily against the references of its anchors: at a
position whose window the reference holds, the longest match becomes a factor.
Factors are at least a window long; windows across a factor's end are looked up
on their own. Windows that their anchor's reference does not hold are rare (they
cross the edge of a passage) and are settled exactly by grouping on the whole
window. No step pairs documents with each other: a document meets one reference
per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_to_table
from .common import _BASE, _BASE_INVERSE, _power_table, mix, partitions, text_bytes, word_hashes

# Words of an anchor group: longer ones leave fewer windows to group, shorter ones fewer anchors.
ANCHOR_WORDS = 32
# Anchor rows of one reference that one task group takes; more are spread over copies of the reference.
GROUP_ROWS = 4096


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power_table("up", _BASE, len(words)), out=sums[1:])
    starts = len(words) - n + 1
    return mix((sums[n:] - sums[:starts]) * _power_table("down", _BASE_INVERSE, starts))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_anchors(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of every window."""
    grams = gram_hashes(words, anchor)
    width = window - anchor + 1
    return sliding_min(grams, width) if len(grams) >= width else np.empty(0, np.uint64)


def _anchor_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, words, bounds in word_hashes(text_bytes(batch.column(1))):
                anchors = window_anchors(words, window, anchor)
                if not len(anchors):
                    continue
                # Runs of equal anchors within a document, then what is left once each.
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchors)]
                inside = np.arange(len(anchors)) + window <= bounds[1:][doc]
                anchors, doc = anchors[inside], doc[inside]
                new = np.ones(len(anchors), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
                anchors, doc = anchors[new], doc[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.view(np.int64)), pa.array(ids[first + doc])], names=["anchor", "doc"]
                )

    return docs.select("doc", "text").mapInArrow(run, "anchor bigint, doc bigint")


SEGMENT = pa.schema(
    [("ref", pa.int64()), ("salt", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("words", pa.binary())]
)


def _segments(placed: DataFrame, window: int, anchor: int) -> DataFrame:
    """Word runs of rows (doc, row, text, shared) by reference: kind 0 for the reference itself, 1 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = text_bytes(batch.column(2))
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            flat = lists.values
            names = flat.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
            refs = flat.field("ref").to_numpy(zero_copy_only=False)
            salts = flat.field("salts").to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            size = 0
            for first, words, bounds in word_hashes(texts):
                for k in range(len(bounds) - 1):
                    i = first + k
                    own = words[bounds[k] : bounds[k + 1]]
                    anchors = window_anchors(own, window, anchor)
                    a, b = at[i], at[i + 1]
                    if not len(anchors) or a == b:
                        continue
                    order = np.argsort(names[a:b])
                    known = names[a:b][order]
                    slot = np.minimum(np.searchsorted(known, anchors), len(known) - 1)
                    hit = known[slot] == anchors
                    which = np.where(hit, a + order[slot], -1)
                    ref = np.where(hit, refs[which], 0)
                    edge = np.flatnonzero((hit[1:] != hit[:-1]) | (ref[1:] != ref[:-1])) + 1
                    for lo, hi in zip([0, *edge], [*edge, len(hit)]):
                        if not hit[lo]:
                            continue
                        n = int(salts[which[lo]])
                        mine = ref[lo] == docs[i]
                        data = own[lo : hi - 1 + window].tobytes()
                        for salt in range(n) if mine else [int(docs[i]) % n]:
                            out.append((int(ref[lo]), salt, 0 if mine else 1, int(docs[i]), int(rows[i]), int(lo), data))
                            size += len(data)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SEGMENT)], schema=SEGMENT)
                            out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SEGMENT)], schema=SEGMENT)

    schema = "ref bigint, salt int, kind int, doc bigint, row bigint, start int, words binary"
    return placed.select("doc", "row", "text", "shared").mapInArrow(run, schema)


class Reference:
    """The indexed word runs of one reference document."""

    def __init__(self, runs: list[np.ndarray], window: int):
        self.window = window
        self.words = np.concatenate(runs)
        hashes, places, at = [], [], 0
        for run in runs:
            hashes.append(gram_hashes(run, window))
            places.append(np.arange(len(hashes[-1])) + at)
            at += len(run)
        self.ends = np.cumsum([len(run) for run in runs])
        hashes, places = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Where each window starts in the reference, -1 if nowhere."""
        slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[slot] == hashes, self.places[slot], -1)

    def longest(self, place: int, words: np.ndarray, start: int) -> int:
        """Length of the match of ``words[start:]`` at a place, within the reference's run."""
        end = self.ends[np.searchsorted(self.ends, place, "right")]
        n = min(end - place, len(words) - start)
        differ = self.words[place : place + n] != words[start : start + n]
        return int(differ.argmax()) if differ.any() else int(n)

    def parse(self, words: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Factor greedily: duplicate spans, and starts and hashes of the windows that are not held."""
        hashes = gram_hashes(words, self.window)
        places = self.look_up(hashes)
        found = np.flatnonzero(places >= 0)
        spans: list[tuple[int, int]] = []
        k = 0
        while k < len(found):
            start = int(found[k])
            end = start + self.longest(int(places[start]), words, start)
            spans.append((start, end))
            # Windows that cross the factor's end are checked one by one; the next factor starts behind it.
            k = int(np.searchsorted(found, end - self.window + 1))
            while k < len(found) and found[k] < end:
                if found[k] > start:
                    spans.append((int(found[k]), int(found[k]) + self.window))
                k += 1
        open_ = np.flatnonzero(places < 0)
        return merge(spans), open_, hashes[open_]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "doc bigint, row bigint, start int, stop int, window bigint"


def _parse(segments: DataFrame, window: int) -> DataFrame:
    """Factor all documents' runs: rows with a span, or with a window still open (stop null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, runs, reference = None, [], None
        for batch in batches:
            ref, salt, kind, doc, row, start = (batch.column(k).to_pylist() for k in range(6))
            words = batch.column(6)
            doc_out, row_out, start_out, stop_out, window_out = [], [], [], [], []
            for i in range(batch.num_rows):
                if (ref[i], salt[i]) != current:
                    current, runs, reference = (ref[i], salt[i]), [], None
                data = np.frombuffer(words[i].as_buffer(), np.uint64)
                if kind[i] == 0:
                    runs.append(data)
                    reference = None
                    continue
                if reference is None:
                    reference = Reference(runs, window)
                spans, open_, hashes = reference.parse(data)
                n = len(spans) + len(open_)
                doc_out += [doc[i]] * n
                row_out += [row[i]] * n
                start_out += [start[i] + a for a, _ in spans] + (start[i] + open_).tolist()
                stop_out += [start[i] + b for _, b in spans] + [None] * len(open_)
                window_out += [None] * len(spans) + hashes.view(np.int64).tolist()
            if runs:
                runs = [r.copy() for r in runs]  # not tied to the batch's memory
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_out, pa.int64()), pa.array(row_out, pa.int64()), pa.array(start_out, pa.int32()), pa.array(stop_out, pa.int32()), pa.array(window_out, pa.int64())],
                names=["doc", "row", "start", "stop", "window"],
            )

    n = partitions(segments)
    grouped = segments.repartition(n, "ref", "salt").sortWithinPartitions("ref", "salt", "kind")
    return grouped.mapInArrow(run, FOUND)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc, row, text): ``row`` tells apart rows that repeat a doc_id with other texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def repeated_spans(docs: DataFrame, window: int = 50, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """Rows (doc, row, start, stop): word spans covered by windows that start in a document with a smaller id too.

    ``row`` is the hash of the text. Spans of a document may overlap. Rows
    without doc_id take no part; rows that repeat one are not held against each
    other. Texts shorter than a window have no spans.
    """
    keyed = _keyed(docs).where("doc is not null")
    anchors = _anchor_rows(keyed, window, anchor)
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("ref"), F.max("doc").alias("last"), F.count("*").alias("n"))
    shared = cut_to_table(shared.where("ref < last").select("anchor", "ref", "n"))
    sizes = shared.groupBy("ref").agg(F.ceil(F.sum("n") / GROUP_ROWS).cast("int").alias("salts"))
    shared = shared.drop("n").join(sizes, "ref")
    lists = (
        anchors.join(shared, "anchor").groupBy("doc").agg(F.collect_set(F.struct("anchor", "ref", "salts")).alias("shared"))
    )
    found = cut_to_table(_parse(_segments(keyed.join(lists, "doc"), window, anchor), window))
    spans = found.where("stop is not null").select("doc", "row", "start", "stop")
    still = found.where("stop is null")
    owners = still.groupBy("window").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last")
    late = still.join(owners, "window").where("doc > owner")
    return spans.unionByName(late.select("doc", "row", "start", (F.col("start") + window).alias("stop")))


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text), one per input row.

    ``kept_text`` is the words outside the repeated spans joined by one space. A
    null or empty text has no words. Repeated rows are each returned.
    """
    spans = repeated_spans(docs, window, anchor)
    lists = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    placed = _keyed(docs).join(lists, ["doc", "row"], "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(text_bytes(batch.column(1)), batch.column(2)):
                words = text.split()
                parts, done, removed = [], 0, 0
                for a, b in merge([(s["start"], s["stop"]) for s in found.as_py() or []]):
                    parts += words[done:a]
                    removed += b - a
                    done = b
                parts += words[done:]
                n_words.append(len(words))
                n_removed.append(removed)
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return placed.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")

"""Near-duplicate groups by MinHash bands, Odd sketches and exact confirmation.

A document's set of word shingles is sampled by minimum hashes. Bands of samples
give buckets of candidates; the samples are also folded into a parity bitmap, an
Odd sketch, and the ones in the XOR of two sketches estimate how similar the
sets are, so that most false candidates go before any text is fetched. What is
left is confirmed on the full sets.

Groups of equal sets are one node. A bucket is not expanded into pairs: every
node meets its bucket's pivot, the best estimate first. Only where members of a
bucket end in different components are the nodes outside its largest component
held against the others, in blocks that carry the full sets; a block returns at
most one confirmed link for a node and a component, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_to_table
from .common import _random_words, mix, partitions, text_bytes, word_hashes

# 32 bands of 4: a pair at similarity 0.85 is missed with chance 5e-11, at 0.8 with 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
# Members of a bucket, and shingles of all of them, that are compared in one block.
BLOCK = 2048
BLOCK_SHINGLES = 500_000

_XOR = (_random_words(7, SAMPLES) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_TIMES = (_random_words(11, SAMPLES) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_PLACES = _random_words(13, 64)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted distinct shingle hashes of each text, in order; fewer words than ``size`` are one shingle, none give none."""
    for first, words, bounds in word_hashes(texts, fold=True):
        n = len(words)
        grams = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            grams = mix(grams + words[k : k + len(grams)] * _PLACES[k])
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b - a >= size:
                yield first + i, np.unique(grams[a : b - size + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for k in range(b - a):
                    whole = mix(whole + words[a + k : a + k + 1] * _PLACES[k])
                yield first + i, mix(whole + np.uint64(b - a))
            else:
                yield first + i, np.empty(0, np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each sampling hash over the set."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 4096):
        np.minimum(out, ((high[at : at + 4096, None] ^ _XOR) * _TIMES).min(axis=0), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """Bucket keys by document and band; a key names its band."""
    wide = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, k])
    return key


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the (sample, minimum) pairs, 64 bits a word."""
    place = mix(minima.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)) + np.uint64(1)) % np.uint64(SKETCH_BITS)
    sketch = np.zeros((len(minima), SKETCH_BITS // 64), np.uint64)
    row = np.repeat(np.arange(len(minima)), SAMPLES)
    place = place.reshape(-1)
    np.bitwise_xor.at(sketch, (row, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return sketch


def most_ones(threshold: float) -> int:
    """Ones in the XOR of two sketches beyond which a pair at the threshold is 5.5 deviations away."""
    low = threshold - 5.5 * math.sqrt(threshold * (1 - threshold) / SAMPLES) - 0.02
    differing = 2 * SAMPLES * (1 - max(0.0, low))
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc, first, second, n, bands, sketch) of (doc, text); the two keys name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            keys = np.zeros((len(texts), 2), np.uint64)
            n = np.zeros(len(texts), np.int64)
            minima = np.zeros((len(texts), SAMPLES), np.uint32)
            for i, shingles in shingle_sets(texts, size):
                n[i] = len(shingles)
                keys[i] = mix(shingles).sum(dtype=np.uint64), mix(shingles + np.uint64(99)).sum(dtype=np.uint64)
                minima[i] = samples(shingles)
            width = SKETCH_BITS // 64
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(minima).reshape(-1).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), pa.array(odd_sketches(minima).reshape(-1).view(np.int64))),
                ],
                names=["doc", "first", "second", "n", "bands", "sketch"],
            )

    schema = "doc bigint, first bigint, second bigint, n bigint, bands array<bigint>, sketch array<bigint>"
    return docs.mapInArrow(run, schema)


def ones(a: Column, b: Column) -> Column:
    """Ones in the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, comp): the smallest node that each node of the edges (a, b) reaches.

    Labels spread to neighbours and jump to their label's label, so long chains
    take logarithmically many rounds; each round is written.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_to_table(both)
    labels = cut_to_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard, "node").select("node", "comp", F.least("comp", "heard").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("further"))
        best = F.least("next", "further")
        moved = cut_to_table(nearer.join(jump, "next").select("node", best.alias("comp"), (F.col("comp") != best).alias("changed")))
        labels = moved.select("node", "comp")
        if moved.where("changed").isEmpty():
            return labels


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. ``a`` may be in many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            one, other = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            keep = np.zeros(len(a), bool)
            for i, mine in shingle_sets(other, size):
                if one[i] != last:
                    last = one[i]
                    held = next(shingle_sets([last], size))[1]
                common = len(np.intersect1d(held, mine, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(held) + len(mine) - common) > 0
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    joined = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("other")), "b")
    joined = joined.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("one")), "a")
    return joined.select("a", "b", "one", "other").mapInArrow(run, "a bigint, b bigint").distinct()


def with_component(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of a node column; a node without links is its own."""
    labels = labels.select(F.col("node").alias(node), F.col("comp").alias("found"))
    return df.join(labels, node, "left").withColumn(name, F.coalesce("found", node)).drop("found")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """Rows (doc, shingles): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for _, s in shingle_sets(text_bytes(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc", "shingles"])

    return texts.select("doc", "text").mapInArrow(run, "doc bigint, shingles binary")


class Members:
    """Some members of a bucket block as arrays; their sets only where the rows carry them."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int):
        part = batch.slice(lo, hi - lo)
        self.doc, self.comp, self.n = (part.column(c).to_numpy() for c in ("doc", "comp", "n"))
        wide = lambda c: part.column(c).flatten().to_numpy().view(np.uint64).reshape(len(self.doc), -1)
        self.sketch, self.bands = wide("sketch"), wide("bands")
        carried = "shingles" in batch.schema.names
        self.sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in part.column("shingles")] if carried else None

    def __len__(self) -> int:
        return len(self.doc)


def alike(asker: Members, i: int, others: Members, band: int, percent: int, limit: int) -> np.ndarray:
    """Places of the others in other components that sizes and sketches leave for member ``i`` of the askers.

    A pair is looked at in the first bucket it shares only.
    """
    small, large = np.minimum(others.n, asker.n[i]), np.maximum(others.n, asker.n[i])
    fits = np.flatnonzero((others.comp != asker.comp[i]) & (100 * small >= percent * large))
    fits = fits[(others.bands[fits] == asker.bands[i]).argmax(axis=1) == band]
    return fits[np.bitwise_count(others.sketch[fits] ^ asker.sketch[i]).sum(axis=1) <= limit]


def confirmed_links(asker: Members, i: int, others: Members, fits: np.ndarray, percent: int) -> list[int]:
    """Of the fitting others one linked document per component, by intersecting the sets."""
    if not len(fits):
        return []
    shingles, n = asker.sets[i], asker.n[i]
    flat = np.concatenate([others.sets[k] for k in fits])
    place = np.minimum(np.searchsorted(shingles, flat), len(shingles) - 1)
    starts = np.cumsum([0, *(len(others.sets[k]) for k in fits[:-1])])
    common = np.add.reduceat((shingles[place] == flat).astype(np.int64), starts)
    linked = fits[100 * common >= percent * (n + others.n[fits] - common)]
    return others.doc[linked[np.unique(others.comp[linked], return_index=True)[1]]].tolist()


def meet(rows: DataFrame, payload: list[str], percent: int, confirm_sets: bool) -> DataFrame:
    """Let the askers of every bucket block meet its members.

    Without sets: rows (key, doc) that some pair leaves after sizes and sketches.
    With sets: confirmed links (a, b).
    """
    hashed = F.xxhash64("doc")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.where("comp <> main").select(
        "key", F.pmod(hashed, F.col("askers")).cast("int").alias("mine"), every("blocks").alias("theirs"), F.lit(0).alias("asks"), *payload
    )
    asked = rows.select(
        "key", every("askers").alias("mine"), F.pmod(hashed, F.col("blocks")).cast("int").alias("theirs"), F.lit(1).alias("asks"), *payload
    )
    limit = most_ones(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, askers = None, []
        for batch in batches:
            key, mine, theirs, asks = (batch.column(k).to_numpy() for k in range(4))
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(mine) != 0) | (np.diff(theirs) != 0)) + 1
            found: set[tuple[int, int]] = set()
            for lo, hi in zip([0, *edge], [*edge, len(key)]):
                if (key[lo], mine[lo], theirs[lo]) != current:
                    current, askers = (key[lo], mine[lo], theirs[lo]), []
                cut = lo + int(np.searchsorted(asks[lo:hi], 1))
                if cut > lo:
                    askers.append(Members(batch, lo, cut))
                if cut == hi:
                    continue
                others, wanted = Members(batch, cut, hi), key[lo].astype(np.uint64)
                for group in askers:
                    for i in range(len(group)):
                        band = int((group.bands[i] == wanted).argmax())
                        fits = alike(group, i, others, band, percent, limit)
                        doc = int(group.doc[i])
                        if confirm_sets:
                            found |= {(min(doc, d), max(doc, d)) for d in confirmed_links(group, i, others, fits, percent)}
                        elif len(fits):
                            found.add((int(key[lo]), doc))
                            found |= {(int(key[lo]), d) for d in others.doc[fits].tolist()}
            a, b = zip(*sorted(found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)

    names = ["a", "b"] if confirm_sets else ["key", "doc"]
    dealt = asking.unionByName(asked).repartition(partitions(rows), "key", "mine", "theirs")
    return dealt.sortWithinPartitions("key", "mine", "theirs", "asks").mapInArrow(run, f"{names[0]} bigint, {names[1]} bigint").distinct()


def remaining_links(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components that still share a bucket.

    In such a bucket the nodes outside its largest component ask all members of
    other components. Both sides are cut into blocks of bounded expected size.
    Sketches meet first; full sets are dealt only for members that a pair is
    left of.
    """
    placed = with_component(buckets.select("key", "doc"), labels, "doc", "comp").join(nodes.select("doc", "n").distinct(), "doc")
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    top = per.groupBy("key").agg(
        F.sum("size").alias("all"), F.sum("shingles").alias("shingles"), F.count("*").alias("kinds"),
        F.max(F.struct("size", "shingles", F.col("comp").alias("main"))).alias("largest"),
    )
    blocks = lambda members, shingles: F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    # Two members have met as node and pivot already.
    top = top.where("kinds > 1 and all > 2").select(
        "key", F.col("largest.main").alias("main"), blocks(F.col("all"), F.col("shingles")).alias("blocks"),
        blocks(F.col("all") - F.col("largest.size"), F.col("shingles") - F.col("largest.shingles")).alias("askers"),
    )
    open_rows = cut_to_table(placed.select("key", "doc", "comp").join(cut_to_table(top), "key"))
    narrow = ["doc", "comp", "n", "sketch", "bands"]
    traits = nodes.select("doc", "n", "sketch", "bands")
    left = cut_to_table(meet(open_rows.join(traits, "doc"), narrow, percent, confirm_sets=False))
    sets = full_sets(texts.join(left.select("doc").distinct(), "doc", "left_semi"), size)
    rows = open_rows.join(left, ["key", "doc"]).join(traits.join(sets, "doc"), "doc")
    return meet(rows, [*narrow, "shingles"], percent, confirm_sets=True)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per input row.

    Words are runs of bytes outside ASCII white space, A-Z folded; sets are of
    ``size``-word shingles; documents with 100 * intersection >= percent * union
    are linked, and ``component_id`` is the smallest id reached. A null, empty
    or blank text has no shingles and no links. Rows that repeat a doc_id are
    one document: their sets' links are joined. A row without doc_id has its
    size, and null for the rest.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    sets = cut_to_table(signatures(keyed, size))
    named = sets.where("n > 0 and doc is not null")
    several = named.groupBy("first", "second").agg(F.min("doc").alias("rep"), F.max("doc").alias("last"))
    several = cut_to_table(several.where("rep < last").drop("last"))
    members = cut_to_table(
        named.join(several, ["first", "second"], "left").withColumn("rep", F.coalesce("rep", "doc")).select("doc", "rep", "n", "bands", "sketch")
    )
    nodes = members.where("doc = rep")
    sketches = nodes.select("doc", "n", "sketch")
    listed = nodes.select("doc", F.explode("bands").alias("key"))
    order = F.struct(F.xxhash64("doc").alias("rank"), F.col("doc").alias("pivot"))
    pivots = listed.groupBy("key").agg(F.min(order).alias("first"), F.max("doc").alias("hi"), F.min("doc").alias("lo")).where("lo < hi")
    pivots = cut_to_table(pivots.select("key", F.col("first.pivot").alias("pivot")))
    buckets = cut_to_table(listed.join(pivots, "key"))
    stars = buckets.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    side = lambda x: sketches.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    apart = ones(F.col("sketch_a"), F.col("sketch_b"))
    alike = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    stars = stars.join(side("b"), "b").join(side("a"), "a").where(alike).withColumn("apart", apart)
    stars = cut_to_table(stars.where(F.col("apart") <= most_ones(percent / 100)).select("a", "b", "apart"))

    # Texts of all nodes that share a bucket: what any later round can ask for.
    asked = buckets.select("doc").distinct()
    texts = cut_to_table(keyed.join(asked, "doc", "left_semi"))

    repeated = members.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where("a < top")
    edges = members.select("doc", F.col("rep").alias("b")).join(repeated.select("doc", "a"), "doc")
    edges = cut_to_table(edges.where("a <> b").select("a", "b").distinct())
    best = stars.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    edges = edges.union(cut_to_table(confirm(best, texts, size, percent)))
    labels = components(edges)

    def across(pairs: DataFrame) -> DataFrame:
        """Pairs between components, each node's component as known."""
        return with_component(with_component(pairs, labels, "a", "comp_a"), labels, "b", "comp_b").where("comp_a <> comp_b").select("a", "b")

    rest = cut_to_table(across(stars.select("a", "b").join(best, ["a", "b"], "left_anti")))
    steps = [
        lambda: confirm(rest, texts, size, percent),
        lambda: remaining_links(buckets, labels, nodes, texts, size, percent),
    ]
    for links in steps:
        confirmed = cut_to_table(links())
        if not confirmed.isEmpty():
            edges = edges.union(confirmed)
            labels = components(edges)
    grouped = with_component(members.select("doc", "rep", "n"), labels, "rep", "component_id")
    alone = sets.where("n = 0 or doc is null").select("doc", F.col("doc").alias("rep"), "n", F.col("doc").alias("component_id"))
    every = grouped.select("doc", "rep", "n", "component_id").union(alone)
    return every.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("doc") == F.col("component_id")).alias("kept")
    )

"""Homomorphic multiset fingerprints of documents, in built-in functions only.

Every paragraph is hashed to a wide vector and the vectors are summed, each lane
modulo 2^60. The sum does not depend on the order of paragraphs, and paragraphs
are inserted or deleted by adding or subtracting their vectors. The first lanes
tell documents apart; the others hold three 20-bit counters of single hash bits
each, sums of random signs whose cosine estimates how much two documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import partitions

# A paragraph ends at a line break or after the end of a sentence.
PARAGRAPH = r"\n+|(?<=[.!?])\s+"
WIDE_LANES = 8
BITS = 20
MASK = (1 << 60) - 1
COUNTERS = (0, 20, 40)
COUNTER_MASK = (1 << 20) - 1
LANES = 1 + WIDE_LANES + 2 * BITS


def paragraphs(text: Column, pattern: str = PARAGRAPH) -> Column:
    """The non-empty paragraphs of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda p: p != "")


def _vector(paragraph: Column) -> Column:
    """The lanes of one paragraph, from its two 64-bit hashes: a one, wide lanes, bit counters."""
    first, second = paragraph["first"], paragraph["second"]
    ones = F.lit(sum(1 << c for c in COUNTERS))
    return F.array(
        F.lit(1).cast("bigint"),
        *[F.xxhash64(F.lit(k), first, second).bitwiseAND(F.lit(MASK)) for k in range(WIDE_LANES)],
        *[F.shiftright(h, j).bitwiseAND(ones) for h in (first, second) for j in range(BITS)],
    )


def _zero() -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), LANES)


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MASK)))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``, which ``a`` must hold."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def fingerprint_of(items: Column) -> Column:
    """Fingerprint of an array of paragraphs as an array of lanes."""
    hashes = F.transform(items, lambda p: F.struct(F.xxhash64(p).alias("first"), F.xxhash64(F.lit(1), p).alias("second")))
    return F.aggregate(hashes, _zero(), lambda total, p: add(total, _vector(p)))


def fingerprint(text: Column, pattern: str = PARAGRAPH) -> Column:
    """Fingerprint of a text: equal texts have equal ones, and so have texts of reordered paragraphs."""
    return fingerprint_of(paragraphs(text, pattern))


def as_text(lanes: Column) -> Column:
    """The lanes as hexadecimal text, 15 digits each."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _counters(lanes: Column) -> Column:
    """The bit counters as sums of signs: twice the count of ones less the paragraphs."""
    n = lanes[0]
    packed = F.slice(lanes, 2 + WIDE_LANES, 2 * BITS)
    one = lambda x, c: (F.shiftright(x, c).bitwiseAND(F.lit(COUNTER_MASK)) * 2 - n).cast("double")
    return F.flatten(F.transform(packed, lambda x: F.array(*[one(x, c) for c in COUNTERS])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two multisets, 0 to 1: 1 for equal fingerprints, 0 where only one is empty."""
    signs_a, signs_b = _counters(a), _counters(b)
    norm = F.sqrt(_dot(signs_a, signs_a) * _dot(signs_b, signs_b))
    cosine = F.when(norm > 0, _dot(signs_a, signs_b) / norm).otherwise(0.0)
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))
    return F.when(a == b, 1.0).when((a[0] == 0) | (b[0] == 0), 0.0).otherwise(estimate)


def neighbours(ids: DataFrame, key: str, carry: str) -> DataFrame:
    """Rows (key, previous key, previous carry) in cyclic ascending order of distinct keys.

    Keys are range-partitioned; neighbours are found within a partition, and
    across partitions from one row per partition.
    """
    ranged = ids.repartitionByRange(partitions(ids), key).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged.select(key, F.struct(key, carry).alias("me"), "part"))
    within = Window.partitionBy("part").orderBy(key)
    across = Window.orderBy("part")
    ends = ranged.groupBy("part").agg(F.max("me").alias("last"))
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(  # one row per partition
        "part", F.coalesce(F.lag("last").over(across), F.max("last").over(everything)).alias("before")
    )
    near = ranged.withColumn("near", F.lag("me").over(within)).join(ends, "part")
    near = near.withColumn("previous", F.coalesce("near", "before"))
    return near.select(key, F.col(f"previous.{key}").alias("previous"), F.col(f"previous.{carry}").alias("previous_carry"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edit with the start of the next document.

    The edited text's last floor(n / 2) code points are the first as many of the
    next document by ascending doc_id, the first after the last. A null text is
    empty. Rows that repeat a doc_id are each returned; where they are the next
    document, the smallest of their texts counts. A row without doc_id is
    fingerprinted, has no next document, and null in the columns on it. Further
    columns are not read. No rows: no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Both joins below start from the same rows, so that the texts are shuffled once.
    named = docs.where("doc_id is not null")
    ids = named.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    order = neighbours(ids, "doc_id", "n_chars")
    placed = named.join(order, "doc_id")
    heads = placed.groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("previous").alias("previous"), F.first("previous_carry").alias("longest")
    )
    heads = heads.select(
        F.col("previous").alias("doc_id"),
        F.substring("text", F.lit(1), F.floor(F.col("longest") / 2).cast("int")).alias("head"),
        fingerprint(F.col("text")).alias("next_lanes"),
    )
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("head", F.lit(1), half))
    apart = docs.where("doc_id is null")
    rows = named.join(heads, "doc_id").unionByName(apart, allowMissingColumns=True)
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), "next_lanes")
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_lanes",
        fingerprint(F.col("text")).alias("lanes"),
        F.when(F.col("edited").isNotNull(), fingerprint(F.col("edited"))).alias("edited_lanes"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )


def sum_fingerprints(lanes: Column) -> Column:
    """Aggregate: the fingerprint of all paragraphs of a group, lane by lane, with partial sums before the shuffle."""
    total = [F.sum(lanes[i].cast("decimal(38,0)")) % F.lit(MASK + 1) for i in range(LANES)]
    return F.array(*[x.cast("bigint") for x in total])

"""Mixing sources to target weights by Poisson replication.

Each source has a repetition rate: target size over present size. A document's
number of copies inverts a Poisson distribution with that mean at a uniform
number hashed from seed and id, so it needs no state and a re-run gives the same
copies. Copies are then range-partitioned and sorted by a hashed key: a global
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import free_names, partitions

# Rates above it are drawn as a sum of that many equal parts.
PART_RATE = 32
# Terms of the distribution kept for a part; the tail beyond is below 1e-30.
TERMS = 128
# More sources than this are joined by salted key instead of being broadcast.
MAX_BROADCAST_SOURCES = 10_000


def hashed_uniform(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from 52 bits of a digest of the parts."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """Distribution function of a Poisson variable at 0, 1, ... as an array."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["c"])


def poisson_copies(rate: Column, table: Column, seed: int, id_column: str) -> Column:
    """Number of copies: for each part of the rate, the distribution values not above its uniform number."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("int") - 1)
    draws = F.transform(
        parts,
        lambda i: F.size(F.filter(table, lambda c: c <= hashed_uniform(F.lit(seed), F.col(id_column), i))),
    )
    return F.aggregate(draws, F.lit(0), lambda a, b: a + b)


def repetition_rates(docs: DataFrame, targets: DataFrame | None, size: Column, budget: float | None) -> DataFrame:
    """Rows (mix_source, rate, table). ``targets``: (source, weight); None: the root of each source's size.

    Weights count relative to each other over the sources present. ``budget``
    is the expected total size after mixing, by default the present one.
    Sources without a positive weight or of no size get rate 0.
    """
    present = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("mix_source")).agg(F.sum(size).cast("double").alias("held"))
    if targets is None:
        weighted = present.withColumn("weight", F.sqrt("held"))
    else:
        wanted = targets.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("mix_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighted = present.join(wanted, "mix_source", "left")
    weighted = weighted.withColumn(
        "weight", F.when((F.col("weight") > 0) & (F.col("held") > 0), F.col("weight")).otherwise(0.0)
    )
    weighted = cut_lineage(weighted)
    total = weighted.agg(F.sum("held").alias("held"), F.sum("weight").alias("weight")).first()
    budget = (total["held"] or 0.0) if budget is None else float(budget)
    whole = total["weight"] or 1.0
    rate = F.when(F.col("weight") > 0, F.lit(budget) * F.col("weight") / F.lit(whole) / F.col("held")).otherwise(0.0)
    rated = weighted.select("mix_source", rate.alias("rate"))
    part = F.col("rate") / F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1))
    return cut_lineage(rated.withColumn("table", poisson_table(part)))


def attach_rates(docs: DataFrame, rates: DataFrame, key: str = "mix_source") -> DataFrame:
    """Join by source: broadcast while the counted sources are few, else by key and salt."""
    docs = docs.withColumn(key, F.coalesce(F.col("source"), F.lit("")))
    if rates.count() <= MAX_BROADCAST_SOURCES:
        return docs.join(F.broadcast(rates), key)
    salts = partitions(docs)
    (salt,) = free_names(docs, "salt")
    docs = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    rates = rates.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return docs.join(rates, [key, salt]).drop(salt)


def mix_sources(
    docs: DataFrame,
    targets: DataFrame | None = None,
    size: Column | None = None,
    budget: float | None = None,
    seed: int = 1,
) -> DataFrame:
    """The documents, each as often as its source's rate asks, in a global hashed order.

    Adds ``copy`` (from 0), ``rate`` and ``mix_key``, replacing columns of these
    names; all other columns stay. ``size`` is what weights measure, by default
    code points. A null source counts as the empty name; a null text has size 0
    and is still drawn with its source's rate; rows that repeat an id are drawn
    alike; a null id is drawn as one id. No rows: no rows.
    """
    size = F.length(F.coalesce(F.col("text"), F.lit(""))) if size is None else size
    names = [c for c in docs.columns if c.lower() not in ("copy", "rate", "mix_key")]
    docs = docs.select(*[f"`{c}`" for c in names])
    key, table, n_copies = free_names(docs, "mix_source", "table", "n_copies")
    rates = repetition_rates(docs, targets, size, budget).withColumnsRenamed({"mix_source": key, "table": table})
    drawn = attach_rates(docs, rates, key)
    copies = poisson_copies(F.col("rate"), F.col(table), seed, "doc_id")
    drawn = drawn.withColumn(n_copies, copies).where(F.col(n_copies) > 0)
    each = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1)))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("copy").cast("string")))
    keyed = each.select(*[f"`{c}`" for c in names], "copy", "rate", place.alias("mix_key"))
    return keyed.repartitionByRange(partitions(docs), "mix_key").sortWithinPartitions("mix_key")

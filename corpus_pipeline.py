"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's documents. All but the last return the
columns of ``documents``; the last returns the packed pieces. Rows, nulls, empty
tables and repeated rows are treated as the operators' docstrings say. Import
errors are not caught here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskpanel.llm.common import free_names
from riskpanel.llm.mixing import mix_sources
from riskpanel.llm.neardup import near_duplicates
from riskpanel.llm.packing import pack_documents
from riskpanel.llm.pii import mask_pii
from riskpanel.llm.queries import table, vocabulary
from riskpanel.llm.toxicity import drop_toxic, fit_toxicity
from riskpanel.session import cut_to_table, ship_package

TOXIC_FROM = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SEQUENCE_TOKENS = 2048
# Words whose ids a worker remembers: few, as the stages before have left the executors less memory.
PACKING_WORDS = 100_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the threshold; the models learn from these documents' labels."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    kept = drop_toxic(docs, model, TOXIC_FROM)
    model.drop()
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the smallest id.

    Every distinct pair of id and text is a document of its own; of rows that
    repeat both one stays. Rows without an id cannot be told apart and all stay.
    """
    ship_package(spark)
    node, place = free_names(docs, "node", "place")
    named = docs.where("doc_id is not null").withColumn(node, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    members = near_duplicates(named.select(F.col(node).alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    ids = named.select(node, F.col("doc_id").alias("id")).distinct()
    grouped = ids.join(members.select(F.col("doc_id").alias(node), "component_id").distinct(), node)
    kept = grouped.groupBy("component_id").agg(F.min(F.struct("id", node)).alias("least")).select(f"least.{node}")
    order = Window.partitionBy(node).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    single = named.join(cut_to_table(kept), node, "left_semi").withColumn(place, F.row_number().over(order))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.where(F.col(place) == 1).select(*columns).unionByName(docs.where("doc_id is null"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data, disguised or not."""
    ship_package(spark)
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source's share follows the root of its size, in a global hashed order."""
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of all documents into sequences."""
    ship_package(spark)
    return pack_documents(docs, vocabulary(), SEQUENCE_TOKENS, remembered=PACKING_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

# The models of the first stage are not expressible in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_to_table(stage(spark, docs, sf_dir))
    return docs

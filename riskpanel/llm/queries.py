"""Queries over the test tables for the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_multiset_fingerprint")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from .fingerprint import fingerprint_edits

    return fingerprint_edits(table(spark, folder, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, folder, "documents"), vocabulary(), 2048)


@query("op7_best_fit_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), vocabulary(), 2048)


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


MIX_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, text, coalesce(source, '') AS mix_source, source, lang, n_chars, length(coalesce(text, '')) AS size FROM documents),
held AS (SELECT mix_source, CAST(sum(size) AS DOUBLE) AS held FROM sized GROUP BY mix_source),
rated AS (
  SELECT mix_source,
         CASE WHEN held > 0 THEN (SELECT sum(held) FROM held) * sqrt(held)
           / (SELECT sum(w) FROM (SELECT sqrt(held) AS w FROM held)) / held ELSE 0.0 END AS rate
  FROM held),
terms AS (
  SELECT mix_source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rated
  UNION ALL
  SELECT mix_source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < 128),
drawn AS (
  SELECT s.doc_id, s.mix_source, any_value(t.rate) AS rate, count(*) AS n_copies
  FROM (SELECT DISTINCT doc_id, mix_source,
               CAST('0x' || substr(md5('1:' || doc_id || ':0'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM sized) s
  JOIN terms t ON s.mix_source = t.mix_source AND t.c <= s.u
  GROUP BY s.doc_id, s.mix_source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, round(rate, 9) AS rate,
       md5('1:order:' || doc_id || ':' || copy) AS mix_key
FROM (SELECT s.*, d.rate, unnest(range(d.n_copies)) AS copy
      FROM sized s JOIN drawn d ON s.doc_id = d.doc_id AND s.mix_source = d.mix_source)
"""


@query("op2_mixing", MIX_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import mix_sources

    mixed = mix_sources(table(spark, folder, "documents"))
    return mixed.withColumn("rate", F.round("rate", 9))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, folder, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))


@query("op8_pii_spans")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, folder, "documents"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substring import remove_repeats

    kept = remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_warc_round_trip")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import uuid

    from pyspark.sql import functions as F

    from ..session import ensure_checkpoint_dir
    from .crawl import page_of, page_records
    from .warc import read_warc, write_warc

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(table(spark, folder, "pages")), path)
    records = read_warc(spark, path).where("record_type in ('response', 'revisit')")
    length = F.when(F.col("record_type") == "response", F.length("payload")).otherwise(F.col("payload_length"))
    return records.select(
        page_of("record_id").alias("page_id"), length.cast("bigint").alias("payload_bytes"), "payload_digest", "record_type",
        page_of("refers_to").alias("refers_to"), F.col("target_uri").alias("url"),
    )


TOP_K_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op5_dual_tree_top_k", TOP_K_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import exact_top_k, finite

    vectors = table(spark, folder, "embeddings").where(finite(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    vectors = vectors.select(F.col("vec_id").alias("id"), whole.alias("vector"))
    best = exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)
    return best.withColumn("score", F.col("score").cast("bigint"))


def _kmeans_sql(k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64) -> str:
    """The assignments and floored means, one pair of steps per round."""
    nearest = """
a{t} AS MATERIALIZED (
  SELECT n, vec_id, v, cluster, distance FROM (
    SELECT k.n, k.vec_id, k.v, c.cluster,
           CAST(list_sum(list_transform(range(1, {dim} + 1), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT) AS distance
    FROM kept k CROSS JOIN c{t} c)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, cluster) = 1)"""
    moved = """
c{u} AS MATERIALIZED (
  SELECT cluster, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN (
    SELECT cluster, list(mean ORDER BY i) AS v FROM (
      SELECT cluster, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS mean
      FROM a{t}, unnest(range(1, {dim} + 1)) AS u(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""
    steps = []
    for t in range(rounds):
        steps += [nearest.format(t=t, dim=dim), moved.format(t=t, u=t + 1, dim=dim)]
    steps.append(nearest.format(t=rounds, dim=dim))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS cluster, v FROM kept WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {k}),
{",".join(steps)}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)
"""


@query("op11_centroid_clustering", _kmeans_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from .centroids import cluster_centroids

    return cluster_centroids(table(spark, folder, "embeddings")).drop("scans")


NEGATIVES_SQL = """
WITH clean AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM clean a JOIN clean c ON a.id % 100 = 0 AND a.id <> c.id AND len(a.v) = len(c.v)),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positive JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .centroids import whole_components
    from .negatives import hard_negatives
    from .topk import finite

    rows = table(spark, folder, "embeddings").where(finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole_components(F.col("embedding"), 256).alias("vector"))
    return hard_negatives(rows, rows.where("id % 100 = 0"))


@query("op13_suffix_dedup")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .suffixes import remove_repeated_bytes

    kept = remove_repeated_bytes(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Crawled pages to WARC records, equal payloads stored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_to_table

PAGE_ID = "urn:riskpanel:page:"


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit(PAGE_ID), F.coalesce(page_id.cast("string"), F.lit("none")))


def page_of(urn: str) -> Column:
    """Page id of a record name, null for a page without one."""
    return F.expr(f"try_cast(substring({urn}, {len(PAGE_ID) + 1}) as bigint)")


def page_records(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows for ``write_warc``: of equal payloads of at least ``least_bytes`` the smallest page_id is a response, others revisit it.

    A null html is an empty payload; a page without id is a response; rows that
    repeat the smallest id are all responses. Only the narrow digests of pages
    are shuffled; payloads stay where they are read unless revisits are many.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload"))
    names = pages.where((F.length("payload") >= least_bytes) & F.col("page_id").isNotNull())
    names = names.select("page_id", F.unhex(F.sha1("payload")).alias("sha1"), F.length("payload").alias("bytes"))
    first = names.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = cut_to_table(first.where("first < last").drop("last"))
    revisits = names.join(first, ["sha1", "bytes"]).where("page_id > first").select("page_id", "sha1", "first").distinct()
    revisits = cut_to_table(revisits.withColumnRenamed("sha1", "same"))
    placed = pages.join(revisits, (pages.page_id == revisits.page_id) & (F.unhex(F.sha1("payload")) == revisits.same), "left")
    revisit = F.col("first").isNotNull()
    return placed.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        page_urn(pages.page_id).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.when(revisit, page_urn(F.col("first"))).alias("refers_to"), "payload",
    )

"""Registry and shared inputs of the catalog."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AREA = ["nation", "segment"]


class Tables:
    """Parquet tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = table
        return table


def query(name: str, sql: str | None = None):
    """Register a query; it gets the tables and returns a DataFrame."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rounded(value: Column | str, digits: int = 6) -> Column:
    return F.round(value, digits)


def big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")


def areas(t: Tables) -> DataFrame:
    """All areas that have a customer."""
    return t.customer.select(
        big("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    ).distinct()


def placed_orders(t: Tables) -> DataFrame:
    """Orders with their area: the incident and lien table."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        "o_custkey",
        big("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("code"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )


def placed_lines(t: Tables) -> DataFrame:
    """Line items with the area of their order: the inspection table."""
    keys = placed_orders(t).select("o_orderkey", "nation", "segment")
    lines = t.lineitem.select(
        "l_orderkey",
        F.col("l_shipdate").cast("date").alias("ship_date"),
        F.col("l_returnflag").alias("result"),
        F.concat_ws(" :: ", "l_returnflag", "l_linestatus").alias("violation"),
    )
    return lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")


PLACED_ORDERS_SQL = """
placed AS (
  SELECT o_orderkey, o_custkey, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment,
         CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS code, o_orderstatus AS status,
         o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey),
areas AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment FROM customer),
bounds AS (SELECT year(min(order_date)) AS lo, year(max(order_date)) AS hi FROM placed),
spine AS (
  SELECT make_date(y, 12, 31) AS period, nation, segment
  FROM areas CROSS JOIN (SELECT unnest(range(lo, hi + 1)) AS y FROM bounds)),
first AS (
  SELECT make_date(year(order_date), 12, 31) AS period, nation, segment, min(order_date) AS first_date
  FROM placed WHERE code LIKE '1%' GROUP BY ALL)
"""

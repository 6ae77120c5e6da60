"""Filters and distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import filters
from .base import Tables, query


@query(
    "filter_keep_null",
    """SELECT c_custkey, o_orderkey, o_orderstatus
       FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey
       WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_orderstatus IS DISTINCT FROM 'P'""",
)
def filter_keep_null(t: Tables):
    large = t.orders.where(F.col("o_totalprice") > 450000)
    joined = t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(filters.differs("o_orderstatus", "F", "P")).select(
        "c_custkey", "o_orderkey", "o_orderstatus"
    )


@query(
    "regex_not_match",
    """SELECT p_partkey, nullif(p_name, 'red ring') AS p_name FROM part
       WHERE coalesce(NOT regexp_matches(nullif(p_name, 'red ring'), '^(?:.*widget)'), true)""",
)
def regex_not_match(t: Tables):
    parts = t.part.select("p_partkey", F.nullif("p_name", F.lit("red ring")).alias("p_name"))
    return filters.not_matching(parts, "p_name", ".*widget")


@query(
    "dropna_subset",
    """SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax,
              nullif(l_returnflag, 'N') AS flag, l_extendedprice
       FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0""",
)
def dropna_subset(t: Tables):
    lines = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        "l_extendedprice",
    )
    return filters.drop_null_rows(lines, ["discount", "tax"])


@query(
    "distinct_rows",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem",
)
def distinct_rows(t: Tables):
    return filters.distinct_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query(
    "rare_category_removal",
    """WITH named AS (SELECT p_partkey, nullif(p_name, 'blue bolt') AS p_name FROM part),
            rare AS (SELECT p_name FROM named WHERE p_name IS NOT NULL AND p_name NOT LIKE 'r%'
                     GROUP BY 1 HAVING count(*) < 30)
       SELECT p_partkey, p_name FROM named
       WHERE p_name IS NULL OR p_name NOT IN (SELECT p_name FROM rare)""",
)
def rare_category_removal(t: Tables):
    parts = t.part.select("p_partkey", F.nullif("p_name", F.lit("blue bolt")).alias("p_name"))
    return filters.drop_rare(parts, "p_name", 30, exempt_prefix="r")


@query(
    "date_range_filter",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders
       WHERE CAST(o_orderdate AS DATE) > DATE '1996-12-31' AND CAST(o_orderdate AS DATE) <= DATE '1999-12-31'""",
)
def date_range_filter(t: Tables):
    days = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    return filters.date_range(days, "order_date", after="1996-12-31", until="1999-12-31")

"""Aggregates, ordering, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import aggregate
from .base import AREA, PLACED_ORDERS_SQL, Tables, big, placed_orders, query


@query(
    "block_profile",
    f"""WITH {PLACED_ORDERS_SQL},
       c1 AS (SELECT nation, segment, code, count(*) AS n FROM placed WHERE code <> '5-LOW' GROUP BY ALL),
       m1 AS (SELECT nation, segment, code FROM (SELECT *, row_number() OVER (PARTITION BY nation, segment
              ORDER BY n DESC, code) AS rn FROM c1) WHERE rn = 1),
       c2 AS (SELECT nation, segment, status, count(*) AS n FROM placed GROUP BY ALL),
       m2 AS (SELECT nation, segment, status FROM (SELECT *, row_number() OVER (PARTITION BY nation, segment
              ORDER BY n DESC, status) AS rn FROM c2) WHERE rn = 1),
       means AS (SELECT nation, segment,
              CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(price) AS price,
              CAST(sum(CAST(CASE WHEN status = 'F' THEN price END AS DECIMAL(18,2))) AS DOUBLE)
                / nullif(count(CASE WHEN status = 'F' THEN price END), 0) AS final_price
              FROM placed GROUP BY ALL)
       SELECT means.nation, means.segment, m1.code, m2.status, price, final_price
       FROM means LEFT JOIN m1 USING (nation, segment) LEFT JOIN m2 USING (nation, segment)""",
)
def block_profile(t: Tables):
    orders = placed_orders(t).select(
        *AREA,
        F.nullif("code", F.lit("5-LOW")).alias("code"),
        "status",
        "price",
        F.when(F.col("status") == "F", F.col("price")).alias("final_price"),
    )
    return aggregate.group_profile(orders, AREA, ["code", "status"], ["price", "final_price"], exact_scale=2)


@query(
    "value_counts",
    "SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1",
)
def value_counts(t: Tables):
    parts = t.part.select(F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand"))
    return aggregate.value_counts(parts, "p_brand")


@query(
    "union_missing_columns",
    """SELECT o_orderkey AS orderkey, CAST(o_orderdate AS DATE) AS event_date, o_orderstatus AS status, NULL AS flag FROM orders
       UNION ALL BY NAME
       SELECT l_orderkey AS orderkey, CAST(l_shipdate AS DATE) AS event_date, l_returnflag AS flag FROM lineitem""",
)
def union_missing_columns(t: Tables):
    return aggregate.union_all_names(
        t.orders.select(
            F.col("o_orderkey").alias("orderkey"),
            F.col("o_orderdate").cast("date").alias("event_date"),
            F.col("o_orderstatus").alias("status"),
        ),
        t.lineitem.select(
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_shipdate").cast("date").alias("event_date"),
            F.col("l_returnflag").alias("flag"),
        ),
    )


@query(
    "top_k",
    """SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_k(t: Tables):
    counts = t.orders.groupBy("o_custkey").agg(big(F.count(F.lit(1))).alias("orders"))
    return aggregate.top_k(counts, "orders", 20, ["o_custkey"])


@query(
    "argmax_first",
    """SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_partkey LIMIT 1""",
)
def argmax_first(t: Tables):
    return aggregate.best_row(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_size", ["p_partkey"])


@query(
    "rows_at_max",
    "SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)",
)
def rows_at_max(t: Tables):
    return aggregate.rows_at_max(t.part.select("p_partkey", "p_size"), "p_size")


@query(
    "area_totals",
    f"""WITH {PLACED_ORDERS_SQL}
       SELECT nation, segment, max(CASE WHEN code LIKE '1%' THEN 1 ELSE 0 END) AS target,
              CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS final_orders,
              CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS amount,
              CAST(count(*) AS BIGINT) AS orders
       FROM placed GROUP BY ALL""",
)
def area_totals(t: Tables):
    """Group max of a flag, group sums of a 0/1 column and of an amount, row count."""
    from ...functions.numbers import money_sum
    from ...functions.text import target_flag

    return placed_orders(t).groupBy(*AREA).agg(
        F.max(target_flag("code")).alias("target"),
        big(F.sum(F.when(F.col("status") == "F", 1).otherwise(0))).alias("final_orders"),
        money_sum("price").alias("amount"),
        big(F.count(F.lit(1))).alias("orders"),
    )

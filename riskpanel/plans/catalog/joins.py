"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import joins
from .base import Tables, big, placed_orders, query


@query(
    "semi_join_distinct",
    """SELECT DISTINCT o_custkey, o_orderstatus FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def semi_join_distinct(t: Tables):
    homes = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    found = joins.semi_join(t.orders, homes, {"o_custkey": "c_custkey"})
    return found.select("o_custkey", "o_orderstatus").distinct()


@query(
    "left_lookup",
    """SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
)
def left_lookup(t: Tables):
    lookup = t.customer.where(F.col("c_acctbal") > 0).select("c_custkey", "c_mktsegment", "c_nationkey")
    return joins.left_lookup(t.orders.select("o_orderkey", "o_custkey"), lookup, {"o_custkey": "c_custkey"})


@query(
    "composite_join",
    """WITH address AS (SELECT DISTINCT l_partkey AS street, CAST(l_suppkey AS VARCHAR) AS house, l_returnflag
                        FROM lineitem WHERE l_returnflag = 'R')
       SELECT l_orderkey, l_linenumber, l_partkey, address.l_returnflag AS parcel
       FROM lineitem JOIN address ON l_partkey = street AND CAST(l_suppkey AS VARCHAR) = house""",
)
def composite_join(t: Tables):
    address = t.lineitem.where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("street"), F.col("l_suppkey").cast("string").alias("house"),
        F.col("l_returnflag").alias("parcel"),
    ).distinct()
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").cast("string").alias("number")
    )
    return joins.equi_join(lines, address, {"l_partkey": "street", "number": "house"}).drop("number")


@query(
    "outer_nway",
    """WITH a AS (SELECT nullif(c_nationkey, 0) AS nation, c_mktsegment AS segment, count(*) AS customers
                  FROM customer GROUP BY ALL),
            b AS (SELECT nullif(c_nationkey, 0) AS nation, c_mktsegment AS segment, count(*) AS rich
                  FROM customer WHERE c_acctbal > 9000 GROUP BY ALL),
            c AS (SELECT nullif(s_nationkey, 0) AS nation, CAST(NULL AS VARCHAR) AS segment, count(*) AS suppliers
                  FROM supplier GROUP BY ALL),
            d AS (SELECT c_nationkey AS nation, nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS poor
                  FROM customer WHERE c_acctbal < 0 GROUP BY ALL),
            ab AS (SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.segment, b.segment) AS segment, customers, rich
                   FROM a FULL JOIN b ON a.nation IS NOT DISTINCT FROM b.nation AND a.segment IS NOT DISTINCT FROM b.segment),
            abc AS (SELECT coalesce(ab.nation, c.nation) AS nation, coalesce(ab.segment, c.segment) AS segment,
                           customers, rich, suppliers
                    FROM ab FULL JOIN c ON ab.nation IS NOT DISTINCT FROM c.nation AND ab.segment IS NOT DISTINCT FROM c.segment)
       SELECT CAST(coalesce(abc.nation, d.nation) AS BIGINT) AS nation, coalesce(abc.segment, d.segment) AS segment,
              customers, rich, suppliers, poor
       FROM abc FULL JOIN d ON abc.nation IS NOT DISTINCT FROM d.nation AND abc.segment IS NOT DISTINCT FROM d.segment""",
)
def outer_nway(t: Tables):
    """Four tables folded by full outer joins; null key parts match each other."""

    def counted(df, nation, segment, name):
        return df.groupBy(big(nation).alias("nation"), segment.alias("segment")).agg(
            big(F.count(F.lit(1))).alias(name)
        )

    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    no_zero = F.nullif("c_nationkey", F.lit(0))
    tables = [
        counted(t.customer, no_zero, segment, "customers"),
        counted(t.customer.where("c_acctbal > 9000"), no_zero, segment, "rich"),
        counted(t.supplier, F.nullif("s_nationkey", F.lit(0)), F.lit(None).cast("string"), "suppliers"),
        counted(t.customer.where("c_acctbal < 0"), nation, F.nullif("c_mktsegment", F.lit("BUILDING")), "poor"),
    ]
    return joins.outer_join_all(tables, ["nation", "segment"])


_MONTHLY_SQL = """
 o AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, CAST(c_nationkey AS BIGINT) AS nation, count(*) AS orders
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1996-06-01' GROUP BY ALL),
 s AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS month, CAST(s_nationkey AS BIGINT) AS nation, count(*) AS lines
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _monthly(t: Tables):
    orders = (
        placed_orders(t).where(F.col("order_date") >= F.lit("1996-06-01").cast("date"))
        .groupBy(F.last_day("order_date").alias("month"), "nation")
        .agg(big(F.count(F.lit(1))).alias("orders"))
    )
    lines = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("month"), big("s_nationkey").alias("nation"))
        .agg(big(F.count(F.lit(1))).alias("lines"))
    )
    return orders, lines


@query(
    "outer_same_keys",
    f"""WITH {_MONTHLY_SQL}
       SELECT coalesce(o.month, s.month) AS month, coalesce(o.nation, s.nation) AS nation, orders, lines
       FROM o FULL JOIN s ON o.month = s.month AND o.nation = s.nation""",
)
def outer_same_keys(t: Tables):
    orders, lines = _monthly(t)
    return orders.join(lines, ["month", "nation"], "full")


@query(
    "outer_diff_keys",
    f"""WITH {_MONTHLY_SQL}
       SELECT o.month AS month, s.month AS ship_month, coalesce(o.nation, s.nation) AS nation, orders, lines
       FROM o FULL JOIN s ON o.month = s.month AND o.nation = s.nation""",
)
def outer_diff_keys(t: Tables):
    orders, lines = _monthly(t)
    lines = lines.withColumnRenamed("month", "ship_month")
    return joins.outer_join_dates(orders, lines, "month", "ship_month", ["nation"])


@query(
    "suffix_join",
    """SELECT c_custkey, a.order_date, b.order_date AS order_date_F, a.price, b.price AS price_F
       FROM (SELECT o_custkey AS c_custkey, min(CAST(o_orderdate AS DATE)) AS order_date, min(o_totalprice) AS price
             FROM orders GROUP BY 1) a
       LEFT JOIN (SELECT o_custkey AS c_custkey, min(CAST(o_orderdate AS DATE)) AS order_date, min(o_totalprice) AS price
             FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) b USING (c_custkey)""",
)
def suffix_join(t: Tables):
    def first_order(df):
        return df.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.min(F.col("o_orderdate").cast("date")).alias("order_date"), F.min("o_totalprice").alias("price")
        )

    urgent = t.orders.where(F.col("o_orderpriority").startswith("1"))
    return joins.suffix_join(first_order(t.orders), first_order(urgent), ["c_custkey"], "left", ("", "_F"))


@query(
    "static_left_join",
    """WITH suppliers AS (SELECT s_nationkey, count(*) AS suppliers, min(s_acctbal) AS lowest FROM supplier GROUP BY 1)
       SELECT c_custkey, n_name, r_name, suppliers, lowest
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN suppliers ON s_nationkey = n_nationkey""",
)
def static_left_join(t: Tables):
    """Attributes per nation, combined by inner joins and attached by a left join."""
    attributes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    attributes = attributes.select(F.col("n_nationkey").alias("nation"), "n_name", "r_name")
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(
        big(F.count(F.lit(1))).alias("suppliers"), F.min("s_acctbal").alias("lowest")
    )
    customers = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"))
    panel = customers.join(attributes, "nation")
    return joins.static_attributes(panel, suppliers, ["nation"]).drop("nation")

"""Column operators, among them those whose column list depends on the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.dates import year_end
from ...operators import columns
from .base import AREA, PLACED_ORDERS_SQL, Tables, big, placed_orders, query


@query(
    "column_projection",
    """SELECT p_partkey AS part_id, p_name, p_type, p_size * 2 AS double_size FROM part""",
)
def column_projection(t: Tables):
    """Drop by name, prefix and position, rename by position, computed column."""
    parts = columns.rename_position(t.part, 0, "part_id").withColumn("double_size", F.col("p_size") * 2)
    parts = columns.drop_columns(parts, ["p_brand"])
    parts = columns.drop_prefixed(parts, "p_retail")
    return columns.drop_positions(parts, [parts.columns.index("p_size")])


def _sparse_orders(t: Tables):
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice")).alias("urgent_price"),
        F.when(F.col("o_orderkey") == 1, F.col("o_orderstatus")).alias("one_status"),
        F.lit(None).cast("string").alias("never"),
    )


@query(
    "drop_sparse_columns_abs",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END AS urgent_price FROM orders""",
)
def drop_sparse_columns_abs(t: Tables):
    return columns.drop_sparse(_sparse_orders(t), min_count=100)


@query(
    "drop_sparse_columns_frac",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_tax END AS returned_tax FROM lineitem""",
)
def drop_sparse_columns_frac(t: Tables):
    lines = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("returned_tax"),
        F.when(F.col("l_discount") == 0.1, F.col("l_tax")).alias("discounted_tax"),
    )
    return columns.drop_sparse(lines, min_fraction=0.15)


@query(
    "non_null_counts",
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (o_orderpriority LIKE '1%') AS BIGINT) AS urgent_price
       FROM orders""",
)
def non_null_counts(t: Tables):
    counts = columns.non_null_counts(_sparse_orders(t))
    return counts.select(F.col("__rows").alias("rows"), "urgent_price")


@query(
    "drop_low_sum_columns",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS status_f,
              o_orderpriority FROM orders""",
)
def drop_low_sum_columns(t: Tables):
    """A third of the orders has the status; a single order and negative sums are dropped."""
    rows = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("status_f"),
        F.when(F.col("o_orderkey") == 1, 1).otherwise(0).alias("one_order"),
        (F.lit(0.0) - F.col("o_totalprice")).alias("negative"),
        "o_orderpriority",
    )
    return columns.drop_low_sum(rows, 0.05, ["status_f", "one_order", "negative"])


@query(
    "fill_zero",
    """SELECT l_orderkey, l_linenumber, l_discount AS discount, coalesce(nullif(l_returnflag, 'N'), NULL) AS flag,
              CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS large FROM lineitem""",
)
def fill_zero(t: Tables):
    """Numeric nulls become 0, texts stay null."""
    return columns.fill_zero(
        t.lineitem.select(
            "l_orderkey",
            "l_linenumber",
            F.nullif("l_discount", F.lit(0.0)).alias("discount"),
            F.nullif("l_returnflag", F.lit("N")).alias("flag"),
            F.when(F.col("l_quantity") > 25, big("l_quantity")).alias("large"),
        )
    )


@query(
    "fill_group_const",
    f"""WITH {PLACED_ORDERS_SQL}
       SELECT o_orderkey, coalesce(first_date, make_date(year(order_date), 12, 31)) AS cutoff
       FROM placed LEFT JOIN first ON period = make_date(year(order_date), 12, 31)
        AND first.nation = placed.nation AND first.segment = placed.segment""",
)
def fill_group_const(t: Tables):
    orders = placed_orders(t).withColumn("period", year_end(F.year("order_date")))
    first = orders.where(F.col("code").startswith("1")).groupBy("period", *AREA).agg(
        F.min("order_date").alias("cutoff")
    )
    joined = orders.join(first, ["period", *AREA], "left")
    return columns.fill_from(joined, "cutoff", "period").select("o_orderkey", "cutoff")


@query(
    "one_hot_single",
    """SELECT l_orderkey, l_linenumber,
              CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS BIGINT) AS flag__A,
              CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS flag__R FROM lineitem""",
)
def one_hot_single(t: Tables):
    """Values are read from the data; a null (flag N) has zeros everywhere."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return columns.one_hot(lines, "flag").drop("flag")


@query(
    "one_hot_multi",
    """SELECT l_orderkey, l_linenumber,
              CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS BIGINT) AS label__A,
              CAST(CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS label__F,
              CAST(CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS BIGINT) AS label__O,
              CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS label__R FROM lineitem""",
)
def one_hot_multi(t: Tables):
    """Labels ' F :: R :: F :: ' style: repeats and empty labels count once or not at all."""
    labels = F.when(
        F.col("l_returnflag") != "N",
        F.concat_ws(" :: ", "l_returnflag", "l_linestatus", F.lit(""), "l_returnflag"),
    )
    lines = t.lineitem.select("l_orderkey", "l_linenumber", labels.alias("label"))
    return columns.one_hot_labels(lines, "label").drop("label")

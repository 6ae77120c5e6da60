"""Panel operators: periods, density, labels, counts before the first target, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...operators import panel as p
from ...operators.columns import quoted
from .base import AREA, PLACED_ORDERS_SQL, Tables, areas, placed_lines, placed_orders, query


def is_target():
    return F.col("code").startswith("1")


def incident_source(t: Tables, orders: DataFrame | None = None) -> p.EventSource:
    orders = placed_orders(t) if orders is None else orders
    return p.EventSource("incident", orders, "order_date", one_hot=["code"], target=is_target())


def inspection_source(t: Tables) -> p.EventSource:
    return p.EventSource("inspection", placed_lines(t), "ship_date", one_hot=["result"], labels=["violation"])


def lien_source(t: Tables) -> p.EventSource:
    liens = placed_orders(t).where(F.col("status") != "O")
    return p.EventSource("lien", liens, "order_date", one_hot=["status"], sums=["price"], cutoff=False)


def order_panel(t: Tables, period: str = "year", **options) -> p.PanelResult:
    """The whole panel of the test tables: label, incidents, inspections and liens."""
    return p.build_panel(
        areas(t),
        [incident_source(t), inspection_source(t), lien_source(t)],
        AREA,
        period=period,
        **options,
    )


def _bounds(df: DataFrame, date: str, period: str):
    return list(p.period_bounds({"events": (df, date)}, period).values())


@query(
    "densify_panel",
    f"""WITH {PLACED_ORDERS_SQL},
       counts AS (SELECT make_date(year(order_date), 12, 31) AS period, nation, segment, count(*) AS orders
                  FROM placed WHERE status = 'F' AND price > 450000 AND year(order_date) <> 1998 GROUP BY ALL)
       SELECT period, nation, segment, CAST(coalesce(orders, 0) AS BIGINT) AS orders
       FROM spine LEFT JOIN counts USING (period, nation, segment)""",
)
def densify_panel(t: Tables):
    """Areas without events and a year without events get zeros."""
    orders = placed_orders(t)
    some = orders.where("status = 'F' and price > 450000 and year(order_date) <> 1998")
    counts = p.add_period(some, "order_date").groupBy("period", *AREA).agg(F.count(F.lit(1)).alias("orders"))
    universe = p.spine(areas(t), _bounds(orders, "order_date", "year"), "year", AREA)
    return p.densify(counts, universe, AREA)


@query(
    "first_target_date",
    f"WITH {PLACED_ORDERS_SQL} SELECT period, nation, segment, first_date FROM first",
)
def first_target_date(t: Tables):
    return p.first_target_dates(placed_orders(t), "order_date", is_target(), AREA)


@query(
    "panel_label",
    f"""WITH {PLACED_ORDERS_SQL}
       SELECT period, nation, segment, CAST(CASE WHEN first_date IS NULL THEN 0 ELSE 1 END AS BIGINT) AS target
       FROM spine LEFT JOIN first USING (period, nation, segment)""",
)
def panel_label(t: Tables):
    orders = placed_orders(t)
    label = p.label_counts(orders, "order_date", is_target(), AREA).drop("first_date")
    return p.densify(label, p.spine(areas(t), _bounds(orders, "order_date", "year"), "year", AREA), AREA)


_CUT_ORDERS_SQL = """
 incident AS (
  SELECT period, nation, segment,
         CAST(count(*) FILTER (code LIKE '2%') AS BIGINT) AS n2, CAST(count(*) FILTER (code LIKE '3%') AS BIGINT) AS n3,
         CAST(count(*) FILTER (code LIKE '4%') AS BIGINT) AS n4, CAST(count(*) FILTER (code LIKE '5%') AS BIGINT) AS n5
  FROM (SELECT *, make_date(year(order_date), 12, 31) AS period FROM placed WHERE code NOT LIKE '1%')
  LEFT JOIN first USING (period, nation, segment)
  WHERE order_date <= coalesce(first_date, period) GROUP BY ALL)"""
_INCIDENT_COLUMNS_SQL = """coalesce(n2, 0) AS "incident__2-HIGH", coalesce(n3, 0) AS "incident__3-MEDIUM",
              coalesce(n4, 0) AS "incident__4-NOT SPECIFIED", coalesce(n5, 0) AS "incident__5-LOW" """


@query(
    "panel_counts",
    f"""WITH {PLACED_ORDERS_SQL}, {_CUT_ORDERS_SQL}
       SELECT period, nation, segment, {_INCIDENT_COLUMNS_SQL}
       FROM spine LEFT JOIN incident USING (period, nation, segment)""",
)
def panel_counts(t: Tables, period: str = "year"):
    """Counts per code up to the first target of the (period, area), zero filled."""
    return p.source_panel(incident_source(t), areas(t), AREA, period)


_CUT_LINES_SQL = """
 lines AS (
  SELECT nation, segment, CAST(l_shipdate AS DATE) AS ship_date, l_returnflag AS result, l_linestatus AS status,
         make_date(year(l_shipdate), 12, 31) AS period
  FROM lineitem JOIN placed ON l_orderkey = o_orderkey),
 line_bounds AS (SELECT year(min(ship_date)) AS lo, year(max(ship_date)) AS hi FROM lines),
 line_spine AS (
  SELECT make_date(y, 12, 31) AS period, nation, segment
  FROM areas CROSS JOIN (SELECT unnest(range(lo, hi + 1)) AS y FROM line_bounds)),
 inspection AS (
  SELECT period, nation, segment,
         CAST(count(*) FILTER (result = 'A') AS BIGINT) AS r_a, CAST(count(*) FILTER (result = 'N') AS BIGINT) AS r_n,
         CAST(count(*) FILTER (result = 'R') AS BIGINT) AS r_r, CAST(count(*) FILTER (status = 'F') AS BIGINT) AS s_f,
         CAST(count(*) FILTER (status = 'O') AS BIGINT) AS s_o
  FROM lines LEFT JOIN first USING (period, nation, segment)
  WHERE ship_date <= coalesce(first_date, period) GROUP BY ALL)"""
_INSPECTION_COLUMNS_SQL = """coalesce(r_a, 0) AS inspection__A, coalesce(r_n, 0) AS inspection__N,
              coalesce(r_r, 0) AS inspection__R, coalesce(r_a, 0) AS inspection__A_2,
              coalesce(r_n, 0) AS inspection__N_2, coalesce(r_r, 0) AS inspection__R_2,
              coalesce(s_f, 0) AS inspection__F, coalesce(s_o, 0) AS inspection__O"""


@query(
    "panel_multilabel",
    f"""WITH {PLACED_ORDERS_SQL}, {_CUT_LINES_SQL}
       SELECT period, nation, segment, {_INSPECTION_COLUMNS_SQL}
       FROM line_spine LEFT JOIN inspection USING (period, nation, segment)""",
)
def panel_multilabel(t: Tables):
    """Counts per result and per label up to the first target; a label named like a result gets a number."""
    first = p.first_target_dates(placed_orders(t), "order_date", is_target(), AREA)
    return p.source_panel(inspection_source(t), areas(t), AREA, "year", first)


_LIEN_SQL = """
 lien AS (
  SELECT make_date(year(order_date), 12, 31) AS period, nation, segment,
         CAST(count(*) FILTER (status = 'F') AS BIGINT) AS l_f, CAST(count(*) FILTER (status = 'P') AS BIGINT) AS l_p,
         CAST(sum(CAST(price AS DECIMAL(29,9))) AS DOUBLE) AS amount
  FROM placed WHERE status <> 'O' GROUP BY ALL)"""
_LIEN_COLUMNS_SQL = """coalesce(l_f, 0) AS lien__F, coalesce(l_p, 0) AS lien__P, coalesce(amount, 0.0) AS lien__price"""


@query(
    "panel_amounts",
    f"""WITH {PLACED_ORDERS_SQL}, {_LIEN_SQL}
       SELECT period, nation, segment, {_LIEN_COLUMNS_SQL}
       FROM spine LEFT JOIN lien USING (period, nation, segment)""",
)
def panel_amounts(t: Tables):
    """Class counts and amounts of the whole period, without a cutoff."""
    return p.source_panel(lien_source(t), areas(t), AREA)


@query(
    "panel_assembled",
    f"""WITH {PLACED_ORDERS_SQL}, {_CUT_ORDERS_SQL}, {_CUT_LINES_SQL}, {_LIEN_SQL},
       suppliers AS (SELECT CAST(s_nationkey AS BIGINT) AS nation, count(*) AS suppliers FROM supplier GROUP BY 1)
       SELECT period, nation, segment, CAST(CASE WHEN first_date IS NULL THEN 0 ELSE 1 END AS BIGINT) AS target,
              {_INCIDENT_COLUMNS_SQL}, {_INSPECTION_COLUMNS_SQL}, {_LIEN_COLUMNS_SQL},
              CAST(coalesce(suppliers, 0) AS BIGINT) AS suppliers
       FROM spine LEFT JOIN first USING (period, nation, segment) LEFT JOIN incident USING (period, nation, segment)
       LEFT JOIN inspection USING (period, nation, segment) LEFT JOIN lien USING (period, nation, segment)
       LEFT JOIN suppliers USING (nation)
       WHERE period <= DATE '2000-12-31'""",
)
def panel_assembled(t: Tables):
    """Label, three sources and static attributes; rare columns would be pruned by their sums."""
    suppliers = t.supplier.groupBy(F.col("s_nationkey").cast("bigint").alias("nation")).agg(
        F.count(F.lit(1)).alias("suppliers")
    )
    attributes = areas(t).join(suppliers, "nation", "left")
    return order_panel(t, min_ratio=0.0001, attributes=attributes, until="2000-12-31").panel


@query(
    "panel_pruned",
    f"""WITH {PLACED_ORDERS_SQL}, {_CUT_ORDERS_SQL}, {_CUT_LINES_SQL}, {_LIEN_SQL},
       frame AS (SELECT (SELECT count(*) FROM spine)
                 + (SELECT count(*) FROM line_spine WHERE period NOT IN (SELECT period FROM spine)) AS n),
       sums AS (
         SELECT 'incident__2-HIGH' AS feature, CAST(sum(n2) AS DOUBLE) AS total FROM incident
         UNION ALL SELECT 'incident__3-MEDIUM', sum(n3) FROM incident
         UNION ALL SELECT 'incident__4-NOT SPECIFIED', sum(n4) FROM incident
         UNION ALL SELECT 'incident__5-LOW', sum(n5) FROM incident
         UNION ALL SELECT 'inspection__A', sum(r_a) FROM inspection UNION ALL SELECT 'inspection__A_2', sum(r_a) FROM inspection
         UNION ALL SELECT 'inspection__N', sum(r_n) FROM inspection UNION ALL SELECT 'inspection__N_2', sum(r_n) FROM inspection
         UNION ALL SELECT 'inspection__R', sum(r_r) FROM inspection UNION ALL SELECT 'inspection__R_2', sum(r_r) FROM inspection
         UNION ALL SELECT 'inspection__F', sum(s_f) FROM inspection UNION ALL SELECT 'inspection__O', sum(s_o) FROM inspection
         UNION ALL SELECT 'lien__F', sum(l_f) FROM lien UNION ALL SELECT 'lien__P', sum(l_p) FROM lien
         UNION ALL SELECT 'lien__price', sum(amount) FROM lien)
       SELECT feature, CAST(n AS BIGINT) AS frame_rows, CASE WHEN total >= n * 3.0 THEN 1 ELSE 0 END AS kept FROM sums, frame""",
)
def panel_pruned(t: Tables):
    """Which count columns survive when a column must average 3 per row of the outer frame."""
    result = order_panel(t, min_ratio=3.0)
    kept = [(name, 1) for name in result.features] + [(name, 0) for name in result.dropped]
    decided = t.spark.createDataFrame(kept, "feature string, kept int")
    return decided.withColumn("frame_rows", F.lit(result.frame_rows).cast("bigint")).select(
        "feature", "frame_rows", "kept"
    )


@query(
    "panel_all_periods",
    f"""WITH {PLACED_ORDERS_SQL}, {_CUT_LINES_SQL}
       SELECT period, nation, segment, CAST(CASE WHEN first_date IS NULL THEN 0 ELSE 1 END AS BIGINT) AS target,
              CAST(coalesce(r_a + r_n + r_r, 0) AS BIGINT) AS inspections
       FROM (SELECT * FROM spine UNION SELECT * FROM line_spine)
       LEFT JOIN first USING (period, nation, segment) LEFT JOIN inspection USING (period, nation, segment)""",
)
def panel_all_periods(t: Tables):
    """Option: periods that only a further source has stay in the panel."""
    panel = order_panel(t, keep_unmatched_periods=True).panel
    total = sum((quoted(f"inspection__{r}") for r in "ANR"), F.lit(0))
    return panel.select("period", *AREA, "target", total.cast("bigint").alias("inspections"))


@query(
    "panel_two_amounts",
    f"""WITH {PLACED_ORDERS_SQL}, {_CUT_LINES_SQL.replace("l_returnflag AS result", "l_extendedprice * l_discount AS price, l_returnflag AS result")},
       line_sums AS (SELECT period, nation, segment, CAST(sum(CAST(round(price, 4) AS DECIMAL(38,6))) AS DOUBLE) AS fine FROM lines GROUP BY ALL),
       order_sums AS (SELECT make_date(year(order_date), 12, 31) AS period, nation, segment,
                             CAST(sum(CAST(price AS DECIMAL(38,6))) AS DOUBLE) AS whole,
                             CAST(count(*) FILTER (status = 'F') AS BIGINT) AS finished
                      FROM placed GROUP BY ALL)
       SELECT period, nation, segment, coalesce(fine, 0.0) AS line__price, coalesce(whole, 0.0) AS order__price,
              CAST(coalesce(finished, 0) AS BIGINT) AS finished
       FROM spine LEFT JOIN line_sums USING (period, nation, segment) LEFT JOIN order_sums USING (period, nation, segment)""",
)
def panel_two_amounts(t: Tables):
    """Two sources with an amount column of the same name, one with four decimals; a fixed list of truth values."""
    orders = placed_orders(t)
    keys = orders.select("o_orderkey", "nation", "segment")
    lines = t.lineitem.select(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("day"), F.round(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("price")
    ).join(keys, F.col("l_orderkey") == F.col("o_orderkey"))
    orders = orders.withColumn("finished", F.col("status") == "F")
    target = p.EventSource("call", orders, "order_date", target=is_target())
    panel = p.build_panel(
        areas(t),
        [
            target,
            p.EventSource("line", lines, "day", sums=["price"], cutoff=False),
            p.EventSource("order", orders, "order_date", one_hot=["finished"], sums=["price"], cutoff=False, values={"finished": [True, False]}),
        ],
        AREA,
    ).panel
    return panel.select("period", *AREA, "line__price", "order__price", quoted("order__True").cast("bigint").alias("finished"))


def word_source(t: Tables) -> p.EventSource:
    """Documents as events of their language and source, with every word of the text as a label."""
    day = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 700).cast("int"))
    rows = t.documents.select("lang", "source", day.alias("day"), "text")
    return p.EventSource("word", rows, "day", labels=["text"], separator=" ", cutoff=False)


_WORDS_SQL = """
 words AS (
  SELECT make_date(year(DATE '2015-01-01' + CAST(doc_id % 700 AS INTEGER)), 12, 31) AS period, lang, source,
         unnest(list_distinct(string_split(text, ' '))) AS value
  FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
 counted AS (SELECT period, lang, source, value, CAST(count(*) AS BIGINT) AS n FROM words WHERE value <> '' GROUP BY ALL)"""


@query(
    "long_label_counts",
    f"""WITH {_WORDS_SQL} SELECT period, lang, source, 'text' AS "column", value, n FROM counted""",
)
def long_label_counts(t: Tables):
    """Any number of labels in long form; no list of values is read."""
    return p.long_counts(word_source(t), ["lang", "source"])


@query(
    "sparse_label_counts",
    f"""WITH {_WORDS_SQL},
       places AS (SELECT value, row_number() OVER (ORDER BY encode(value)) - 1 AS index FROM (SELECT DISTINCT value FROM counted))
       SELECT period, lang, source, CAST(count(*) AS BIGINT) AS filled, CAST(sum(n) AS BIGINT) AS total,
              CAST(sum(n * index) AS BIGINT) AS weighted, CAST(min(index) AS BIGINT) AS first_index, CAST(max(index) AS BIGINT) AS last_index
       FROM counted JOIN places USING (value) GROUP BY ALL""",
)
def sparse_label_counts(t: Tables):
    """The long counts as one sparse vector per (period, language, source), told by its sums."""
    keys = ["lang", "source"]
    counts = p.long_counts(word_source(t), keys)
    rows = p.sparse_counts(counts, p.value_index(counts), keys)
    add = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return rows.select(
        "period", *keys, F.size("counts").cast("bigint").alias("filled"), add(F.col("counts")).alias("total"),
        add(F.zip_with("indices", "counts", lambda i, n: i * n)).alias("weighted"),
        F.element_at("indices", 1).alias("first_index"), F.element_at("indices", -1).alias("last_index"),
    )

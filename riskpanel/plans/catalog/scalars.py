"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import dates, numbers, text
from .base import Tables, big, query

# The characters removed by strip, spelled for SQL.
_BLANKS = " || ".join(f"chr({ord(c)})" for c in text.WHITESPACE)


@query(
    "text_clean_chain",
    """SELECT c_custkey,
         trim(regexp_replace(replace(replace(replace(
           '  ' || c_mktsegment || ', PGH, Rd, Place' || c_name || chr(9), ', PGH', ''), ', P', ''), ',', ''),
           '#[^\\n]*', '', 'g')) AS street,
         replace(c_mktsegment || ' AV' || ' NAVY', 'AV', 'AVE') AS street_type,
         regexp_replace(c_mktsegment || ' AV NAVY', '\\bAV\\b', 'AVE', 'g') AS street_type_word,
         replace(c_nationkey || '  - ' || c_mktsegment, '  -', ' -') AS code,
         CASE WHEN c_acctbal >= 0 THEN c_mktsegment || ' ' || c_name END AS full_name,
         split_part(c_name, '#', 1) AS first_name_part,
         split_part(c_mktsegment, '/', 1) AS unsplit
       FROM customer""",
)
def text_clean_chain(t: Tables):
    raw = F.concat(F.lit("  "), "c_mktsegment", F.lit(", PGH, Rd, Place"), "c_name", F.lit("\t"))
    return t.customer.select(
        "c_custkey",
        text.clean_street(raw).alias("street"),
        text.normalise_street_type(F.concat("c_mktsegment", F.lit(" AV NAVY"))).alias("street_type"),
        text.normalise_street_type(F.concat("c_mktsegment", F.lit(" AV NAVY")), whole_word=True).alias(
            "street_type_word"
        ),
        text.normalise_code(F.concat(F.col("c_nationkey").cast("string"), F.lit("  - "), "c_mktsegment")).alias("code"),
        text.join_strict(" ", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), "c_name").alias("full_name"),
        text.first_part("c_name", "#").alias("first_name_part"),
        text.first_part("c_mktsegment", "/").alias("unsplit"),
    )


@query(
    "document_text_clean",
    f"""WITH cleaned AS (
         SELECT doc_id, text,
           trim(regexp_replace(replace(replace(replace(text, ', PGH', ''), ', P', ''), ',', ''),
                '#[^\\n]*', '', 'g'), {_BLANKS}) AS cleaned
         FROM documents)
       SELECT doc_id, md5(cleaned) AS cleaned_hash, CAST(length(cleaned) AS BIGINT) AS cleaned_chars,
              split_part(text, ' ', 1) AS first_word,
              nullif(regexp_extract(text, '([0-9]+)[.]([0-9]+)', 1), '') AS whole,
              nullif(regexp_extract(text, '([0-9]+)[.]([0-9]+)', 2), '') AS fraction
       FROM cleaned""",
)
def document_text_clean(t: Tables):
    """The street rules over whole document texts."""
    whole, fraction = text.extract_groups("text", r"([0-9]+)[.]([0-9]+)", 2)
    cleaned = text.clean_street("text")
    return t.documents.select(
        "doc_id",
        F.md5(cleaned).alias("cleaned_hash"),
        big(F.length(cleaned)).alias("cleaned_chars"),
        text.first_part("text", " ").alias("first_word"),
        whole.alias("whole"),
        fraction.alias("fraction"),
    )


@query(
    "regex_extract_pair",
    """WITH named AS (
         SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'Block Group ' || (s_nationkey // 3) || ', Census Tract '
                  || (s_suppkey // 10) || '.' || (s_suppkey - 10 * (s_suppkey // 10)) ELSE s_name END AS geography
         FROM supplier)
       SELECT s_suppkey, geography,
         nullif(regexp_extract(geography, 'Block Group (\\d), Census Tract (\\d+\\.?\\d*)', 1), '') AS block,
         nullif(regexp_extract(geography, 'Block Group (\\d), Census Tract (\\d+\\.?\\d*)', 2), '') AS tract,
         CAST(round(CAST(nullif(regexp_extract(geography,
              'Block Group (\\d), Census Tract (\\d+\\.?\\d*)', 2), '') AS DECIMAL(18,6)) * 100) AS BIGINT) AS tract_key
       FROM named""",
)
def regex_extract_pair(t: Tables):
    geography = F.when(
        F.col("s_acctbal") > 0,
        F.concat(
            F.lit("Block Group "), F.expr("string(s_nationkey div 3)"), F.lit(", Census Tract "),
            F.expr("string(s_suppkey div 10)"), F.lit("."), F.expr("string(s_suppkey - 10 * (s_suppkey div 10))"),
        ),
    ).otherwise(F.col("s_name"))
    block, tract = text.extract_groups("geography", text.GEOGRAPHY_PATTERN, 2)
    return t.supplier.select("s_suppkey", geography.alias("geography")).select(
        "s_suppkey", "geography", block.alias("block"), tract.alias("tract"),
        numbers.scaled_key(tract).alias("tract_key"),
    )


@query(
    "date_parts_and_year_end",
    """WITH days AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS d FROM orders)
       SELECT o_orderkey, d AS order_date, CAST(year(d) AS BIGINT) AS order_year,
              make_date(year(d), 12, 31) AS year_end,
              CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
              last_day(d) AS month_end,
              CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE) AS week_end, d AS day_end
       FROM days""",
)
def date_parts_and_year_end(t: Tables):
    """Dates from texts in two formats; a bad text has no date."""
    stamp = (
        F.when(F.col("o_orderstatus") == "P", "13/45/199x")
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "M/d/yyyy HH:mm:ss"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    )
    days = t.orders.select("o_orderkey", dates.parse_date(dates.date_text(stamp)).alias("order_date"))
    return days.select(
        "o_orderkey",
        "order_date",
        big(F.year("order_date")).alias("order_year"),
        dates.year_end(F.year("order_date")).alias("year_end"),
        *[dates.period_end("order_date", p).alias(f"{p}_end") for p in ("quarter", "month", "week", "day")],
    )


DATE_SHAPES = (
    "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "M/d/yyyy", "MM/dd/yy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm", "dd-MMM-yyyy", "MMM d, yyyy",
    "d MMMM yyyy HH:mm:ss",
)


@query(
    "date_shapes",
    f"""SELECT o_orderkey, CAST(k AS INTEGER) AS shape, CAST(o_orderdate AS TIMESTAMP) AS moment, CAST(o_orderdate AS DATE) AS day
       FROM orders CROSS JOIN (SELECT unnest(range({len(DATE_SHAPES)})) AS k)""",
)
def date_shapes(t: Tables):
    """Every order date written in fourteen ways and read back; none is lost."""
    written = [F.struct(F.lit(k).alias("shape"), F.date_format("o_orderdate", s).alias("raw")) for k, s in enumerate(DATE_SHAPES)]
    rows = t.orders.select("o_orderkey", F.explode(F.array(*written)).alias("w")).select("o_orderkey", "w.shape", "w.raw")
    return rows.select("o_orderkey", "shape", dates.parse_timestamp("raw").alias("moment"), dates.parse_date("raw").alias("day"))


@query(
    "date_rejects",
    """SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS rejects,
              CAST(count(*) FILTER (o_orderstatus <> 'P') AS BIGINT) AS parsed
       FROM orders GROUP BY 1""",
)
def date_rejects(t: Tables):
    stamp = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    rows = t.orders.select("o_orderpriority", stamp.alias("stamp"), dates.parse_timestamp(stamp).alias("parsed"))
    return rows.groupBy("o_orderpriority").agg(
        dates.count_rejects("stamp", "parsed").alias("rejects"), big(F.count("parsed")).alias("parsed")
    )


@query(
    "first_char_label",
    """WITH coded AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS code FROM orders)
       SELECT o_orderkey, substr(code, 1, 1) AS code_class,
              CASE WHEN substr(code, 1, 1) = '1' THEN 1 ELSE 0 END AS target FROM coded""",
)
def first_char_label(t: Tables):
    code = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return t.orders.select(
        "o_orderkey", text.first_char(code).alias("code_class"), text.target_flag(code).alias("target")
    )


@query(
    "scalar_exprs",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity,
              CAST(round(CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(18,6)) * 100) AS BIGINT) AS discount_key,
              l_extendedprice / nullif(l_discount, 0) AS price_per_discount,
              round(l_discount * 10) AS rounded,
              CASE WHEN l_discount + l_tax > 0 THEN 2 * l_discount * l_tax / (l_discount + l_tax) END AS f1,
              CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.07 THEN 1 ELSE 2 END AS bin,
              TRY_CAST(l_returnflag AS BIGINT) AS not_a_number
       FROM lineitem""",
)
def scalar_exprs(t: Tables):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        big("l_quantity").alias("quantity"),
        numbers.scaled_key(F.col("l_discount").cast("string")).alias("discount_key"),
        numbers.safe_ratio(F.col("l_extendedprice"), F.col("l_discount")).alias("price_per_discount"),
        F.round(F.col("l_discount") * 10, 0).alias("rounded"),
        numbers.f1_score(F.col("l_discount"), F.col("l_tax")).alias("f1"),
        numbers.bin_index("l_discount", [0.0, 0.03, 0.07, 0.1]).alias("bin"),
        F.col("l_returnflag").try_cast("bigint").alias("not_a_number"),
    )

"""The domain cleaning plans on sources shaped from the test tables.

A customer is a parcel, orders are incidents (an old file before 1998, a new
one from then on) and liens, line items are inspections, suppliers give the
census counts. The shaping only renames and formats; all rows take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import cleaning, residential
from .base import Tables, query

PLACE = residential.Place(city="RIVERTON", municipality="Riverton", subdivision="Riverton city")
RARE = 20


# ---------------------------------------------------------------- shaping, Spark side


def parcel_id(key: str):
    return F.concat(F.lit("P"), F.col(key).cast("string"))


def mixed_dates(day, key):
    """A date as the portals' exports write it, in one of several ways."""
    shapes = (
        "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss.S", "M/d/yyyy h:mm:ss a",
        "dd-MMM-yyyy", "MMMM d, yyyy",
    )
    turn = F.pmod(key, F.lit(len(shapes)))
    return F.coalesce(*[F.when(turn == k, F.date_format(day, shape)) for k, shape in enumerate(shapes)])


def assessments(t: Tables) -> DataFrame:
    balance = F.col("c_acctbal")
    return t.customer.select(
        parcel_id("c_custkey").alias("PARID"),
        F.col("c_nationkey").cast("string").alias("PROPERTYHOUSENUM"),
        F.replace("c_name", F.lit("#"), F.lit(" ")).alias("PROPERTYADDRESS"),
        F.when(balance < 0, "ELSEWHERE").otherwise("RIVERTON").alias("PROPERTYCITY"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "COMMERCIAL").otherwise("RESIDENTIAL").alias("CLASSDESC"),
        F.col("c_mktsegment").alias("MUNIDESC"),
        F.substring("c_mktsegment", 1, 1).alias("SCHOOLDESC"),
        F.col("c_nationkey").cast("string").alias("NEIGHCODE"),
        F.when(balance > 5000, "10 - Taxable").otherwise("20 - Exempt").alias("TAXDESC"),
        F.when(balance <= 9000, F.when(balance > 3000, "REGULAR").otherwise("CORPORATION")).alias("OWNERDESC"),
        F.when(balance > 4000, "SINGLE").otherwise("TWO").alias("USEDESC"),
        (balance * 10).alias("LOTAREA"),
        F.when(balance > 1000, balance).alias("SALEPRICE"),
        (balance + 1).alias("FAIRMARKETBUILDING"),
        (balance + 2).alias("FAIRMARKETLAND"),
        F.when(F.col("c_custkey") == 1, F.lit("x")).alias("ALMOSTEMPTY"),
    )


def parcels(t: Tables) -> DataFrame:
    nation = F.col("c_nationkey")
    return t.customer.select(
        F.when(nation == 22, "Some County land").when(nation == 23, " ").when(nation == 24, "COMMON GROUND")
        .otherwise(parcel_id("c_custkey")).alias("PIN"),
        ((nation + 1) * 100).cast("bigint").alias("TRACTCE10"),
        ((F.length("c_mktsegment") - 7) * 1000 + 12).cast("string").alias("BLOCKCE10"),
        F.when(F.col("c_acctbal") > 500, "Riverton city").otherwise("Other town").alias("geo_name_cousub"),
    )


def inspections(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.lit(" 1 ").alias("STREET_NUM"),
        F.lit("\tANY ").alias("STREET_NAME"),
        parcel_id("o_custkey").alias("PARCEL"),
        F.date_format("l_shipdate", "M/d/yyyy").alias("INSPECTION_DATE"),
        F.col("l_returnflag").alias("INSPECTION_RESULT"),
        F.when(F.col("l_discount") > 0, F.concat_ws(" :: ", "l_linestatus", F.lit("X"))).alias("VIOLATION"),
    )


def liens(t: Tables) -> DataFrame:
    return t.orders.select(
        parcel_id("o_custkey").alias("pin"),
        F.when(F.col("o_orderstatus") == "O", "Elsewhere").otherwise("Riverton").alias("municipality"),
        mixed_dates(F.col("o_orderdate"), F.col("o_orderkey")).alias("filing_date"),
        F.year("o_orderdate").cast("bigint").alias("tax_year"),
        F.col("o_orderpriority").alias("lien_description"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("amount"),
        F.col("o_orderstatus").alias("satisfied"),
    )


def _incident_orders(t: Tables) -> DataFrame:
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    excluded = F.when(
        F.col("o_totalprice") > 490000, F.lit("  353 - Removal of victim(s) from stalled elevator ")
    ).when(F.col("o_totalprice") < 1200, F.concat(F.lit("9-"), F.col("o_orderkey").cast("string")))
    return orders.select(
        excluded.alias("odd_code"),
        F.substring("o_orderpriority", 1, 1).alias("digit"),
        F.expr("substring(o_orderpriority, 3)").alias("rest"),
        "c_name",
        F.col("c_nationkey").cast("string").alias("house"),
        F.col("o_orderdate").alias("day"),
    )


def incidents_old(t: Tables) -> DataFrame:
    rows = _incident_orders(t).where(F.col("day") < F.lit("1998-01-01").cast("timestamp_ntz"))
    name = F.split("c_name", "#")
    return rows.select(
        F.coalesce("odd_code", F.concat("digit", F.lit("35  - "), "rest")).alias("full.code"),
        F.concat(F.lit(" "), F.get(name, 0), F.lit("\t")).alias("street"),
        F.concat(F.lit(" "), F.get(name, 1)).alias("st_type"),
        F.concat("house", F.lit(" ")).alias("number"),
        mixed_dates(F.col("day"), F.xxhash64("c_name")).alias("CALL_CREATED_DATE"),
        F.lit("unit").alias("PRIMARY_UNIT"),
    )


def incidents_new(t: Tables) -> DataFrame:
    rows = _incident_orders(t).where(F.col("day") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    plain = F.replace("c_name", F.lit("#"), F.lit(" "))
    return rows.select(
        F.coalesce("odd_code", F.concat("digit", F.lit("35 - "), "rest")).alias("full.code"),
        F.when(F.col("digit") == "2", F.concat(F.lit("  "), plain, F.lit(", PGH")))
        .when(F.col("digit") == "3", F.concat(plain, F.lit("/OTHER ST")))
        .when(F.col("digit") == "4", F.concat(plain, F.lit(" #12")))
        .otherwise(plain).alias("street"),
        F.col("house").alias("number"),
        mixed_dates(F.col("day"), F.xxhash64("c_name")).alias("CALL_CREATED_DATE"),
        F.lit("x").alias("alarms"),
    )


def census_tables(t: Tables) -> list[DataFrame]:
    """Two census tables as they land: the first row holds the real names, numbers are texts."""
    rich = F.count_if(F.col("s_acctbal") > 4000)
    blocks = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("block")
    base = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), rich.alias("r")).select("*", blocks)
    geography = F.concat(
        F.lit("Block Group "), F.col("block").cast("string"), F.lit(", Census Tract "),
        (F.col("s_nationkey") + 1).cast("string"), F.lit(", Some County"),
    )

    def landed(names: list[str], value) -> DataFrame:
        codes = [f"c{i}" for i in range(8)]
        header = t.spark.createDataFrame([tuple(["Id", "Id2", "Geography", *names])], ", ".join(f"{c} string" for c in codes))
        rows = base.select(
            F.lit("g").alias("c0"), F.lit("2").alias("c1"), geography.alias("c2"), F.lit("9").alias("c3"),
            F.lit("1").alias("c4"), value.cast("string").alias("c5"), F.lit("**").alias("c6"),
            (value * F.col("block")).cast("string").alias("c7"),
        )
        return header.unionByName(rows)

    income = ["Estimate; Total", "Margin of Error; Total", "Estimate; Income", "Margin of Error; Income", "Estimate; By. block"]
    built = ["Estimate; Total", "Margin of Error; Total", "Estimate; Built", "Margin of Error; Built", "Estimate; Age"]
    return [landed(income, F.col("n")), landed(built, F.col("r"))]


def sources(t: Tables) -> residential.Sources:
    return residential.Sources(
        inspections(t), assessments(t), liens(t), parcels(t), census_tables(t), incidents_old(t), incidents_new(t)
    )


def prepared(t: Tables) -> residential.Prepared:
    return residential.prepare(sources(t), PLACE, rare_count=RARE, min_values=10)


# ---------------------------------------------------------------- the same in SQL

_SHAPES_SQL = """
assessments AS (
  SELECT 'P' || c_custkey AS PARID, CAST(c_nationkey AS VARCHAR) AS PROPERTYHOUSENUM, replace(c_name, '#', ' ') AS PROPERTYADDRESS,
         CASE WHEN c_acctbal < 0 THEN 'ELSEWHERE' ELSE 'RIVERTON' END AS PROPERTYCITY,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'COMMERCIAL' ELSE 'RESIDENTIAL' END AS CLASSDESC,
         c_mktsegment AS MUNIDESC, substr(c_mktsegment, 1, 1) AS SCHOOLDESC, CAST(c_nationkey AS VARCHAR) AS NEIGHCODE,
         CASE WHEN c_acctbal > 5000 THEN '10 - Taxable' ELSE '20 - Exempt' END AS TAXDESC,
         CASE WHEN c_acctbal <= 9000 THEN CASE WHEN c_acctbal > 3000 THEN 'REGULAR' ELSE 'CORPORATION' END END AS OWNERDESC,
         CASE WHEN c_acctbal > 4000 THEN 'SINGLE' ELSE 'TWO' END AS USEDESC, c_acctbal * 10 AS LOTAREA,
         CASE WHEN c_acctbal > 1000 THEN c_acctbal END AS SALEPRICE, c_acctbal + 1 AS FAIRMARKETBUILDING,
         c_acctbal + 2 AS FAIRMARKETLAND
  FROM customer),
homes AS (SELECT DISTINCT * FROM assessments WHERE PROPERTYCITY = 'RIVERTON' AND CLASSDESC = 'RESIDENTIAL'),
properties AS (SELECT * FROM homes WHERE PROPERTYHOUSENUM <> '0'),
parcel_areas AS (
  SELECT DISTINCT 'P' || c_custkey AS PIN, CAST((c_nationkey + 1) * 100 AS BIGINT) AS tract,
         CAST(length(c_mktsegment) - 7 AS BIGINT) AS block
  FROM customer WHERE c_acctbal > 500 AND c_nationkey < 22),
census AS (
  SELECT CAST((s_nationkey + 1) * 100 AS BIGINT) AS tract, CAST(block AS BIGINT) AS block,
         CAST(count(*) AS DOUBLE) AS income, CAST(count(*) * block AS DOUBLE) AS by_block,
         CAST(count(*) FILTER (s_acctbal > 4000) AS DOUBLE) AS built,
         CAST(count(*) FILTER (s_acctbal > 4000) * block AS DOUBLE) AS age
  FROM supplier, (SELECT unnest([1, 2, 3]) AS block) GROUP BY s_nationkey, block)"""

_INSPECTIONS_SQL = """
inspections AS (
  SELECT DISTINCT 'P' || o_custkey AS PARCEL, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS INSPECTION_DATE,
         l_returnflag AS INSPECTION_RESULT, CASE WHEN l_discount > 0 THEN l_linestatus || ' :: X' END AS VIOLATION,
         CAST(year(l_shipdate) AS INTEGER) AS violation_year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE 'P' || o_custkey IN (SELECT PARID FROM homes)),
inspection_areas AS (
  SELECT tract, block, INSPECTION_DATE, INSPECTION_RESULT, VIOLATION, violation_year
  FROM inspections JOIN parcel_areas ON PARCEL = PIN)"""

_LIENS_SQL = """
liens AS (
  SELECT DISTINCT 'P' || o_custkey AS pin, CAST(o_orderdate AS DATE) AS filing_date, make_date(year(o_orderdate), 12, 31) AS tax_year,
         o_orderpriority AS lien_description, o_totalprice AS amount, o_orderstatus AS satisfied
  FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' AND 'P' || o_custkey IN (SELECT PARID FROM homes)),
lien_areas AS (
  SELECT tract, block, filing_date, tax_year, lien_description, amount, satisfied
  FROM liens JOIN parcel_areas ON liens.pin = parcel_areas.PIN)"""

_INCIDENTS_SQL = """
incidents AS (
  SELECT DISTINCT substr(o_orderpriority, 1, 1) || '35 - ' || substr(o_orderpriority, 3) AS code,
         replace(c_name, '#', ' ') AS street, CAST(c_nationkey AS VARCHAR) AS number,
         CAST(o_orderdate AS DATE) AS CALL_CREATED_DATE, CAST(year(o_orderdate) AS INTEGER) AS incident_year
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice <= 490000 AND o_totalprice >= 1200),
incident_areas AS (
  SELECT DISTINCT CALL_CREATED_DATE, code, tract, block
  FROM incidents JOIN homes ON street = PROPERTYADDRESS AND number = PROPERTYHOUSENUM JOIN parcel_areas ON PARID = PIN)"""


def _mode_sql(column: str) -> str:
    return f"""m_{column} AS (
  SELECT tract, block, {column} FROM (
    SELECT tract, block, {column}, row_number() OVER (PARTITION BY tract, block ORDER BY count(*) DESC, {column}) AS rn
    FROM placed WHERE {column} IS NOT NULL GROUP BY tract, block, {column}) WHERE rn = 1)"""


_PROFILE_SQL = (
    "placed AS (SELECT properties.*, tract, block FROM properties JOIN parcel_areas ON PARID = PIN),\n"
    + ",\n".join(_mode_sql(c) for c in cleaning.PROFILE_MODES)
    + """,
profile AS (
  SELECT tract, block, """
    + ", ".join(f"{c}" for c in cleaning.PROFILE_MODES)
    + ", "
    + ", ".join(
        f"(SELECT CAST(sum(CAST({c} AS DECIMAL(29,9))) AS DOUBLE) / nullif(count({c}), 0) FROM placed p WHERE p.tract = k.tract AND p.block = k.block) AS {c}"
        for c in cleaning.PROFILE_MEANS
    )
    + """, income AS "Estimate Income", by_block AS "Estimate By_ block", built AS "Estimate Built", age AS "Estimate Age"
  FROM (SELECT DISTINCT tract, block FROM placed) k """
    + " ".join(f"LEFT JOIN m_{c} USING (tract, block)" for c in cleaning.PROFILE_MODES)
    + " JOIN census USING (tract, block))"
)


@query(
    "census_clean",
    f"""WITH {_SHAPES_SQL} SELECT tract, block, income AS "Estimate Income", by_block AS "Estimate By_ block" FROM census""",
)
def census_clean(t: Tables):
    """Second header line promoted, totals and margins dropped, keys extracted, numbers cast."""
    return cleaning.clean_census(census_tables(t)[0])


@query(
    "census_combined",
    f"""WITH {_SHAPES_SQL} SELECT tract, block, income AS "Estimate Income", by_block AS "Estimate By_ block",
        built AS "Estimate Built", age AS "Estimate Age" FROM census""",
)
def census_combined(t: Tables):
    return cleaning.combine_census([cleaning.clean_census(c) for c in census_tables(t)])


@query("property_clean", f"WITH {_SHAPES_SQL} SELECT {', '.join(cleaning.PROPERTY_COLUMNS)} FROM properties")
def property_clean(t: Tables):
    return cleaning.clean_properties(assessments(t), PLACE.city, min_values=10)[0]


@query("address_lookup", f"WITH {_SHAPES_SQL} SELECT PARID, PROPERTYADDRESS, PROPERTYHOUSENUM FROM homes")
def address_lookup(t: Tables):
    return cleaning.clean_properties(assessments(t), PLACE.city, min_values=None)[1]


@query("parcel_areas", f"WITH {_SHAPES_SQL} SELECT PIN, tract, block FROM parcel_areas")
def parcel_areas(t: Tables):
    return cleaning.parcel_areas(parcels(t), PLACE.subdivision)


@query("inspection_clean", f"WITH {_SHAPES_SQL}, {_INSPECTIONS_SQL} SELECT * FROM inspections")
def inspection_clean(t: Tables):
    return cleaning.clean_inspections(inspections(t), address_lookup(t))


@query("lien_clean", f"WITH {_SHAPES_SQL}, {_LIENS_SQL} SELECT * FROM liens")
def lien_clean(t: Tables):
    return cleaning.clean_liens(liens(t), address_lookup(t), PLACE.municipality)


@query("inspection_areas", f"WITH {_SHAPES_SQL}, {_INSPECTIONS_SQL} SELECT * FROM inspection_areas")
def inspection_areas(t: Tables):
    return cleaning.events_to_areas(inspection_clean(t), parcel_areas(t), "PARCEL")


@query("lien_areas", f"WITH {_SHAPES_SQL}, {_LIENS_SQL} SELECT * FROM lien_areas")
def lien_areas(t: Tables):
    return cleaning.events_to_areas(lien_clean(t), parcel_areas(t), "pin")


@query("incident_clean", f"WITH {_SHAPES_SQL}, {_INCIDENTS_SQL} SELECT code, street, number, CALL_CREATED_DATE, incident_year FROM incidents")
def incident_clean(t: Tables):
    """Both incident files; rare codes (odd ones, once each) and excluded codes are gone."""
    return cleaning.clean_incidents(incidents_old(t), incidents_new(t), RARE)


@query("incident_areas", f"WITH {_SHAPES_SQL}, {_INCIDENTS_SQL} SELECT * FROM incident_areas")
def incident_areas(t: Tables):
    return cleaning.incidents_to_areas(incident_clean(t), address_lookup(t), parcel_areas(t), min_fraction=0.15)


@query("area_profile", f"WITH {_SHAPES_SQL}, {_PROFILE_SQL} SELECT * FROM profile")
def area_profile(t: Tables):
    census = census_combined(t)
    return cleaning.area_profile(property_clean(t), parcel_areas(t), census)[0]


@query(
    "residential_panel",
    f"""WITH {_SHAPES_SQL}, {_PROFILE_SQL}, {_INSPECTIONS_SQL}, {_LIENS_SQL}, {_INCIDENTS_SQL},
       areas AS (SELECT tract, block FROM profile),
       years AS (SELECT unnest(range(lo, hi + 1)) AS y FROM
                 (SELECT year(min(CALL_CREATED_DATE)) AS lo, year(max(CALL_CREATED_DATE)) AS hi FROM incident_areas)),
       first AS (SELECT year(CALL_CREATED_DATE) AS y, tract, block, min(CALL_CREATED_DATE) AS first_date
                 FROM incident_areas WHERE code LIKE '1%' GROUP BY ALL),
       n AS (SELECT y, tract, block, count(*) FILTER (code LIKE '2%') AS n2, count(*) FILTER (code LIKE '3%') AS n3,
                    count(*) FILTER (code LIKE '4%') AS n4, count(*) FILTER (code LIKE '5%') AS n5
             FROM (SELECT *, year(CALL_CREATED_DATE) AS y FROM incident_areas WHERE code NOT LIKE '1%')
             LEFT JOIN first USING (y, tract, block)
             WHERE CALL_CREATED_DATE <= coalesce(first_date, make_date(y, 12, 31)) GROUP BY ALL),
       i AS (SELECT y, tract, block, count(*) FILTER (INSPECTION_RESULT = 'A') AS ra, count(*) FILTER (INSPECTION_RESULT = 'N') AS rn,
                    count(*) FILTER (INSPECTION_RESULT = 'R') AS rr, count(*) FILTER (VIOLATION LIKE 'F%') AS vf,
                    count(*) FILTER (VIOLATION LIKE 'O%') AS vo, count(VIOLATION) AS vx
             FROM (SELECT *, year(INSPECTION_DATE) AS y FROM inspection_areas)
             LEFT JOIN first USING (y, tract, block)
             WHERE INSPECTION_DATE <= coalesce(first_date, make_date(y, 12, 31)) GROUP BY ALL),
       l AS (SELECT year(tax_year) AS y, tract, block, count(*) FILTER (lien_description LIKE '1%') AS l1,
                    count(*) FILTER (lien_description LIKE '2%') AS l2, count(*) FILTER (lien_description LIKE '3%') AS l3,
                    count(*) FILTER (lien_description LIKE '4%') AS l4,
                    CAST(sum(CAST(amount AS DECIMAL(29,9))) AS DOUBLE) AS amount
             FROM lien_areas GROUP BY ALL)
       SELECT make_date(y, 12, 31) AS period, tract, block, CAST(CASE WHEN first_date IS NULL THEN 0 ELSE 1 END AS BIGINT) AS target,
              CAST(coalesce(n2 + n3 + n4 + n5, 0) AS BIGINT) AS incidents, CAST(coalesce(n3, 0) AS BIGINT) AS incidents_3,
              CAST(coalesce(ra + rn + rr, 0) AS BIGINT) AS inspections, CAST(coalesce(vf, 0) AS BIGINT) AS violations_f,
              CAST(coalesce(vx, 0) AS BIGINT) AS violations_x, CAST(coalesce(l1 + l2 + l3 + l4, 0) AS BIGINT) AS liens,
              coalesce(amount, 0.0) AS amount, CASE WHEN USEDESC = 'SINGLE' THEN 1 ELSE 0 END AS use_single,
              coalesce(SALEPRICE, 0.0) AS sale_price, "Estimate Income" AS income
       FROM areas CROSS JOIN years LEFT JOIN first USING (y, tract, block) LEFT JOIN n USING (y, tract, block)
       LEFT JOIN i USING (y, tract, block) LEFT JOIN l USING (y, tract, block) JOIN profile USING (tract, block)
       WHERE y <= 2000""",
)
def residential_panel(t: Tables):
    """All sources through cleaning, linking and assembly."""
    result = residential.residential_panel(prepared(t), until="2000-12-31")
    panel = result.panel

    def total(*names: str):
        return sum((F.col(f"`{n}`") for n in names), F.lit(0)).cast("bigint")

    codes = [c for c in panel.columns if c.startswith("incident__")]
    return panel.select(
        "period", "tract", "block", "target",
        total(*codes).alias("incidents"),
        total(*[c for c in codes if c.startswith("incident__3")]).alias("incidents_3"),
        total("inspection__A", "inspection__N", "inspection__R").alias("inspections"),
        total("inspection__F").alias("violations_f"),
        total("inspection__X").alias("violations_x"),
        total(*[c for c in panel.columns if c.startswith("lien__") and c != "lien__amount"]).alias("liens"),
        F.col("lien__amount").alias("amount"),
        F.col("USEDESC__SINGLE").cast("int").alias("use_single"),
        F.col("SALEPRICE").alias("sale_price"),
        F.col("`Estimate Income`").alias("income"),
    )

"""Compare Spark rows with DuckDB rows, ignoring row and column order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


# Spark type to the DuckDB type that holds the same values.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    types = {row[0]: row[1] for row in con.execute("DESCRIBE " + sql).fetchall()}
    return names, types, rows


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is not None, str(v)) for v in row),
    )


def compare(df, con, sql: str) -> list[str]:
    """Differences as text, empty when the results agree."""
    problems = []
    names, types, rows = duck_rows(con, sql)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    spark_rows = [tuple(r) for r in df.collect()]
    left_names, left = normal(df.columns, spark_rows)
    right_names, right = normal(names, rows)
    if left_names != right_names:
        return [f"columns {left_names} != {right_names}"]
    for name in left_names:
        if spark_types[name] != types[name]:
            problems.append(f"type of {name}: {spark_types[name]} != {types[name]}")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if not left:
        problems.append("both empty")
    if different:
        problems.append(f"{len(different)} rows differ, first: {different[0][0]} != {different[0][1]}")
    return problems

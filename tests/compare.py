"""Runs a query in Spark and its SQL in DuckDB and compares rows, names and types."""

from __future__ import annotations

import decimal
import math

import duckdb

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f")
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(picked, key=lambda r: tuple((v is not None, str(v)) for v in r))


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE", "date": "DATE",
}


def type_name(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return spark_type.upper()
    return _TYPES.get(spark_type, spark_type)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when both sides agree."""
    cursor = con.execute(sql)
    duck_names = [d[0] for d in cursor.description]
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    right = cursor.fetchall()
    left = [tuple(r) for r in df.collect()]
    found = []
    if sorted(df.columns) != sorted(duck_names):
        return [f"columns {sorted(df.columns)} != {sorted(duck_names)}"]
    for name, kind in df.dtypes:
        if type_name(kind) != duck_types[name].replace(", ", ","):
            found.append(f"type of {name}: {kind} != {duck_types[name]}")
    if len(left) != len(right):
        found.append(f"row count {len(left)} != {len(right)}")
    a, b = rows_of(df.columns, left), rows_of(duck_names, right)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y][:2]
        found.append(f"rows differ: {odd}")
    return found

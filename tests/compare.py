"""Run a query on Spark and its SQL on DuckDB and compare names, types and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short text on how they differ."""
    result = con.sql(sql)
    spark_types = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    duck_types = {name: str(kind) for name, kind in zip(result.columns, result.types)}
    if spark_types != duck_types:
        odd = {k: (spark_types.get(k), duck_types.get(k)) for k in spark_types | duck_types
               if spark_types.get(k) != duck_types.get(k)}
        return f"schema {odd}"
    left = _rows(df.collect(), df.columns)
    right = _rows(result.fetchall(), result.columns)
    if left == right:
        return None
    only_left, only_right = list((left - right).items()), list((right - left).items())
    return (
        f"rows {sum(left.values())} vs {sum(right.values())}; columns {sorted(df.columns)}\n"
        f"  spark only {len(only_left)}: {sorted(only_left)[:2]}\n"
        f"  duckdb only {len(only_right)}: {sorted(only_right)[:2]}"
    )

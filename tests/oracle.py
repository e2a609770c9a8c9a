"""Side-by-side run of a registered query on Spark and its reference SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def spark_result(df):
    return _table(df.columns, df.collect())


def duckdb_result(con, sql):
    cursor = con.execute(sql)
    return _table([d[0] for d in cursor.description], cursor.fetchall())


def difference(left, right) -> str | None:
    """None if both results agree in columns and rows (as bags), else what differs."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    only_left, only_right = left[1] - right[1], right[1] - left[1]
    return (
        f"rows {left[1].total()} / {right[1].total()}, unmatched {only_left.total()} / {only_right.total()}; "
        f"first {list(only_left)[:2]} / {list(only_right)[:2]}"
    )

"""Comparison of a query with its SQL twin: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, int):
        return float(value)
    return value


def multiset(rows, names) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else a short description of the difference."""
    spark_names = list(df.columns)
    spark_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    sql_names = [d[0] for d in cur.description]
    sql_rows = cur.fetchall()
    if sorted(spark_names) != sorted(sql_names):
        return f"columns {sorted(spark_names)} != {sorted(sql_names)}"
    left, right = multiset(spark_rows, spark_names), multiset(sql_rows, sql_names)
    if left == right:
        return ""
    extra, missing = left - right, right - left
    return (
        f"rows {len(spark_rows)} vs {len(sql_rows)}; only here {sum(extra.values())}: {list(extra)[:2]}; "
        f"only in SQL {sum(missing.values())}: {list(missing)[:2]}"
    )

"""Holds a query's rows against DuckDB's."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(x: object) -> object:
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    return x


def rows(columns: list[str], data: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if they agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"

"""Runs a query and its SQL side by side and compares rows, as sets with counts."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads=4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that compares and hashes alike whichever engine made it."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return value


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def compare(spark, sf_dir: str, query, sql: str, con=None) -> str:
    """Empty if equal, else what differs."""
    con = con or connect(sf_dir)
    df = query(spark, sf_dir)
    names, theirs = rows_of_sql(con, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    place = [names.index(c) for c in order]
    b = Counter(tuple(plain(r[i]) for i in place) for r in theirs)
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"

"""Compares a query's rows with its DuckDB twin's."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def spark_rows(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[str]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())

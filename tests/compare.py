"""A query's rows against its SQL's in DuckDB, as multisets."""

from __future__ import annotations

import os
from collections import Counter

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows_of(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(str(r[c]) for c in columns) for r in df.collect())


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    places = [names.index(c) for c in columns]
    return columns, Counter(tuple(str(r[i]) for i in places) for r in found.fetchall())

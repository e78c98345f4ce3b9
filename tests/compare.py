"""Side-by-side comparison of a named query with its SQL, as rows and as types."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else repr(v)) for v in row)


def sorted_rows(rows: list[tuple]) -> list[tuple]:
    clean = [
        tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row) for row in rows
    ]
    return sorted(clean, key=_key)


_TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def spark_result(df) -> tuple[list[tuple[str, str]], list[tuple]]:
    columns = sorted(df.columns)
    types = [(c, _TYPE_NAMES.get(df.schema[c].dataType.simpleString(), "?")) for c in columns]
    return types, sorted_rows([tuple(r) for r in df.select(*columns).collect()])


def duck_result(con, sql: str) -> tuple[list[tuple[str, str]], list[tuple]]:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    by_name = dict(zip(rel.columns, map(str, rel.types)))
    picked = rel.project(", ".join(f'"{n}"' for n in names))
    return [(n, by_name[n]) for n in names], sorted_rows(picked.fetchall())

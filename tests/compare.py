"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


#: Names of equal types.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date"}


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = [TYPES.get(str(c[1]), str(c[1])) for c in cur.description]
    return sorted(zip(names, kinds)), rows(names, cur.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.dtypes), rows(df.columns, [tuple(r) for r in df.collect()])


def difference(df, sf_dir: str, sql: str) -> str | None:
    """None if equal, else what differs."""
    (a, x), (b, y) = spark_rows(df), sql_rows(sf_dir, sql)
    if a != b:
        return f"columns {a} and {b}"
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows; {[r for r in x if r not in set(y)][:2]} and {[r for r in y if r not in set(x)][:2]}"
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else None

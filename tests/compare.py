"""Spark and SQL results as comparable multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def family(type_name: str) -> str:
    """Column types that both engines share, under one name."""
    kind = str(type_name).lower().split("(")[0]
    return {"integer": "int", "varchar": "string", "hugeint": "bigint"}.get(kind, kind)


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark result and a SQL result; empty if nothing."""
    relation = con.sql(sql)
    ours = sorted((f.name, family(f.dataType.simpleString())) for f in df.schema)
    theirs = sorted((n, family(t)) for n, t in zip(relation.columns, relation.types))
    found = []
    if ours != theirs:
        found.append(f"schema {sorted(set(ours) ^ set(theirs))}")
    a = _rows(df.columns, [tuple(r) for r in df.collect()])
    b = _rows(relation.columns, relation.fetchall())
    if not b:
        found.append("the SQL result is empty")
    if a != b:
        only_a, only_b = a - b, b - a
        found.append(
            f"rows {sum(a.values())} and {sum(b.values())}, "
            f"only Spark {list(only_a.items())[:2]}, only SQL {list(only_b.items())[:2]}"
        )
    return found

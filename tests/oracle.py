"""Compare a registered query with its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

from workload.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def _rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def _kind(name: str) -> str:
    name = name.lower()
    for kind, names in {
        "bigint": ("bigint", "long"),
        "int": ("integer", "int"),
        "double": ("double",),
        "text": ("varchar", "string"),
        "time": ("timestamp_ntz", "timestamp"),
        "bool": ("boolean",),
    }.items():
        if name in names:
            return kind
    return name


def differences(con, df: DataFrame, sql: str) -> list[str]:
    """What differs, in words; empty when both agree."""
    relation = con.sql(sql)
    mine = _rows(df.columns, df.collect())
    theirs = _rows(relation.columns, relation.fetchall())
    problems = []
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} vs {theirs[0]}"]
    types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema}
    other = {c: _kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    problems += [f"type of {c}: {types[c]} vs {other[c]}" for c in types if types[c] != other[c]]
    if len(mine[1]) != len(theirs[1]):
        problems.append(f"rows {len(mine[1])} vs {len(theirs[1])}")
    elif mine[1] != theirs[1]:
        bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    return problems

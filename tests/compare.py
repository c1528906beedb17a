"""Spark's rows against DuckDB's: columns by name, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, Decimal):
        return v.normalize()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def duck(sql: str, sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c.sql(sql)


FAMILY = {"bigint": "long", "integer": "int", "smallint": "smallint", "varchar": "string", "double": "double", "boolean": "boolean", "timestamp": "timestamp", "date": "date"}


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs; nothing if the results are equal."""
    rel = duck(sql, sf_dir)
    names, theirs_names = sorted(df.columns), sorted(rel.columns)
    if names != theirs_names:
        return [f"columns {names} and {theirs_names}"]
    found = []
    kinds = dict(df.dtypes)
    for c, t in zip(rel.columns, rel.types, strict=True):
        t = str(t).lower()
        mine = {"bigint": "long"}.get(kinds[c], kinds[c]).replace("timestamp_ntz", "timestamp")
        if t in FAMILY and mine != FAMILY[t] or t == "hugeint":
            found.append(f"column {c} is {kinds[c]} and {t}")
    mine = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    place = [rel.columns.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    if mine != theirs:
        found.append(f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}; {names}")
    return found

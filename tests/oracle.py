"""Compares a query's rows with DuckDB's for the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import re

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1 << 52 else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def kind(t: str) -> str:
    t = str(t).lower()
    if re.match(r"(tiny|small|big|huge|u)?int|long|bigint|integer", t):
        return "int"
    if re.match(r"double|float|decimal", t):
        return "float"
    return "text" if re.match(r"varchar|string", t) else "bool" if t.startswith("bool") else t


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and a query; nothing if they agree."""
    names = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    kinds = {c[0]: kind(c[1]) for c in cur.description}
    out = []
    if sorted(cols) != names:
        return [f"columns {names} against {sorted(cols)}"]
    mine = {n: kind(t) for n, t in df.dtypes}
    out += [f"{n} is {mine[n]} against {kinds[n]}" for n in names if mine[n] != kinds[n]]
    at = [cols.index(c) for c in names]
    other = sorted(tuple(plain(r[k]) for k in at) for r in cur.fetchall())
    if len(rows) != len(other):
        out.append(f"{len(rows)} rows against {len(other)}")
    a, b = [r for r in rows if r not in set(other)], [r for r in other if r not in set(rows)]
    if a or b:
        out.append(f"{len(a)} and {len(b)} rows differ, such as {dict(zip(names, a[0])) if a else None} against {dict(zip(names, b[0])) if b else None}")
    return out

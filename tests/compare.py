"""Run a registered query and its SQL oracle on the same tables and compare them as row bags."""

from __future__ import annotations

import math
import os

import duckdb

from clipmill.plans.views import TABLES


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if hasattr(v, "item"):
        return _cell(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "asDict"):
        return _cell(v.asDict())
    if isinstance(v, dict):
        return tuple((k, _cell(x)) for k, x in sorted(v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None if equal, else a short text."""
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    ocols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}"
    if got != want:
        extra = [x for x in got if x not in set(want)][:2] if len(got) < 200000 else []
        lack = [x for x in want if x not in set(got)][:2] if len(got) < 200000 else []
        return f"rows {len(got)} vs {len(want)}; spark only {extra}; sql only {lack}"
    types = {k: t for k, t in df.dtypes}
    otypes = dict(zip([c[0] for c in cur.description], [str(c[1]).lower() for c in cur.description]))
    odd = {k: (types[k], otypes[k]) for k in types if not _same_kind(types[k], otypes[k])}
    return f"types {odd}" if odd else None


def _same_kind(a, b):
    kinds = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
    if a in kinds:
        return b == kinds[a]
    return True

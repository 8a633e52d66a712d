"""Run a query and its DuckDB SQL on the same tables."""

from __future__ import annotations

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf: str = SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def rows_of(df) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr), cols


def rows_by_sql(query: str, sf: str = SF) -> list:
    cur = connect(sf).execute(query)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr), cols

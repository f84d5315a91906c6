"""Run a query and its SQL over the same tables and compare names and values."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or hasattr(v, "quantize"):
        return None if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def duck(sql: str, data: str = DATA) -> tuple[list[str], list]:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def assert_same(df, sql: str, data: str = DATA) -> int:
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    names, rows = duck(sql, data)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(repr([plain(r[i]) for i in at]) for r in rows)
    return len(ours)

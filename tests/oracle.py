"""Comparison of a query with its SQL in DuckDB, by multisets of rows."""

from __future__ import annotations

import decimal
import os
from collections import Counter

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canonical(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str(sorted((k, canonical(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([canonical(x) for x in v])
    return str(v)


def database():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        name = f.split(".")[0]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def compare(spark, name: str, query, sql: str) -> None:
    df = query(spark, DATA)
    cols = sorted(df.columns)
    mine = Counter(tuple(canonical(r[c]) for c in cols) for r in df.collect())
    r = database().execute(sql)
    theirs = [d[0] for d in r.description]
    assert sorted(theirs) == cols, name
    at = [theirs.index(c) for c in cols]
    other = Counter(tuple(canonical(row[i]) for i in at) for row in r.fetchall())
    assert mine == other, (name, list((mine - other).items())[:3], list((other - mine).items())[:3])

"""Compare registered queries with their DuckDB texts: same columns, same rows."""

from __future__ import annotations

import math
from collections import Counter

from lurewatch.sources.fixtures import TABLES


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        x = x.replace(tzinfo=None)
    return x if not hasattr(x, "as_tuple") else float(x)


def compare(spark, con, sf_dir, query, sql) -> str:
    """'' if equal, else what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    if not want:
        return "no rows to compare"
    if got != want:
        return f"{cols}: only Spark {list((got - want).items())[:2]}, only SQL {list((want - got).items())[:2]} of {sum(got.values())}, {sum(want.values())}"
    return ""


def views(con, sf_dir):
    for t in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con

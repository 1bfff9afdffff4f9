"""Side-by-side comparison of a registered query and its SQL over the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        path = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if rows and column names agree, else what differs."""
    got = query(spark, sf_dir)
    cursor = connection(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} against {sorted(names)}"
    rows = Counter(tuple(plain(r[n]) for n in names) for r in (x.asDict(True) for x in got.collect()))
    want = Counter(tuple(plain(v) for v in r) for r in cursor.fetchall())
    if rows == want:
        return ""
    return f"{sum((rows - want).values())} rows of {sum(rows.values())} only in Spark, e.g. {list(rows - want)[:2]}; {sum((want - rows).values())} of {sum(want.values())} only in SQL, e.g. {list(want - rows)[:2]}"

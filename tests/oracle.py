"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    got = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return False, f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = _bag(got, spark_df.columns), _bag(want, names)
    if a == b:
        return True, f"{len(got)} rows"
    extra, lost = list((a - b).items())[:3], list((b - a).items())[:3]
    return False, f"{len(got)} vs {len(want)} rows; only spark ({sum((a - b).values())}): {extra}; only sql: {lost}; cols {sorted(names)}"

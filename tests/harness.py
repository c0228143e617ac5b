"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return ""
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
            return "" if math.isnan(v) else f"{float(v) + 0.0:.5g}"
        if isinstance(v, bool) or str(type(v)).endswith("bool_'>") or str(type(v)).endswith("numpy.bool'>"):
            return str(bool(v))
        if hasattr(v, "__index__"):
            return str(int(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None))


def numbers(rows):
    out = []
    for row in rows:
        parts = []
        for c in row:
            try:
                parts.append(f"{float(c):.5g}")
            except ValueError:
                parts.append(c)
        out.append(tuple(parts))
    return sorted(out)


def compare(spark, con, fn, sql, sf_dir) -> tuple[str, float, int]:
    start = time.time()
    got = fn(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return "rows", took, len(got)
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", took, len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", took, len(got)
    a, b = numbers(canonical(got)), numbers(canonical(want))
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"values differ in {sum(x != y for x, y in zip(a, b))} rows: {diff}", took, len(got)
    return "ok", took, len(got)

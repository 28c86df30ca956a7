"""Compare a Spark query with its DuckDB oracle the way the driver does:
row count, column names, and order-insensitive values (floats to 6 dp)."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        r = round(v, 6)
        if r == 0:
            r = 0.0
        return (1, f"{r:.6f}")
    if isinstance(v, int):
        return (1, f"{float(v):.6f}") if False else (1, str(v))
    if isinstance(v, (list, tuple)):
        return (3, str([_norm(x) for x in v]))
    return (1, str(v))


def rows_of_spark(df):
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


def compare(spark_df, con, sql: str, tol: float = 2e-6):
    scols, srows = rows_of_spark(spark_df)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}")
        return problems
    if len(srows) != len(drows):
        problems.append(f"row count spark={len(srows)} duck={len(drows)}")
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    s_sorted = sorted(tuple(_norm(r[i]) for i in si) for r in srows)
    d_sorted = sorted(tuple(_norm(r[i]) for i in di) for r in drows)
    exact_mismatch = 0
    for a, b in zip(s_sorted, d_sorted):
        if a == b:
            continue
        exact_mismatch += 1
        for x, y in zip(a, b):
            if x == y:
                continue
            try:
                if abs(float(x[1]) - float(y[1])) <= tol:
                    continue
            except ValueError:
                pass
            problems.append(f"value mismatch: spark={a} duck={b}")
            break
        if len(problems) > 5:
            break
    return problems

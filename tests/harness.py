"""Oracle comparison used by the tests: Spark result vs DuckDB SQL on the same parquet.

Mirrors the driver's check: row count, column names, and an order-insensitive hash
of the values (columns sorted by name).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, (int,)):
        return float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("ORACLE_STRICT") else float(f"{v:.9g}")
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v)


def rows_of_spark(df):
    cols = df.columns
    rows = [tuple(_norm(r[c]) if not hasattr(r[c], "asDict") else _norm(r[c].asDict(True))
                  for c in cols) for r in df.collect()]
    return cols, rows


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    cols = rel.columns
    rows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]
    return cols, rows


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(r[i] for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark_df, con, sql):
    sc, sr = rows_of_spark(spark_df)
    dc, dr = rows_of_duck(con, sql)
    problems = []
    if sorted(sc) != sorted(dc):
        problems.append(f"columns differ: spark={sc} duck={dc}")
        return problems
    if len(sr) != len(dr):
        problems.append(f"row count spark={len(sr)} duck={len(dr)}")
    hs, ls = digest(sc, sr)
    hd, ld = digest(dc, dr)
    if hs != hd:
        only_s = sorted(set(ls) - set(ld))[:5]
        only_d = sorted(set(ld) - set(ls))[:5]
        problems.append(f"values differ; cols={sorted(sc)}\n spark-only={only_s}\n duck-only={only_d}")
    return problems

"""Compare a registered Spark query with its DuckDB oracle.

Mirrors the driver's check: row count, column names, and an order-insensitive
hash of the values with columns sorted by name.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

from tessera.sources.tables import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest(), keyed


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "spark_rows": len(s_rows), "spark_cols": sorted(s_cols),
           "spark_types": dict(df.dtypes)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck_connect(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out.update(duck_rows=len(d_rows), duck_cols=sorted(d_cols),
               duck_types=dict(zip(d_cols, [str(t) for t in rel.types])))
    hs, ks = _digest(s_cols, s_rows)
    hd, kd = _digest(d_cols, d_rows)
    ok = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and hs == hd
    out["status"] = "match" if ok else "MISMATCH"
    if not ok:
        sd, dd = set(ks), set(kd)
        out["only_spark"] = sorted(sd - dd)[:3]
        out["only_duck"] = sorted(dd - sd)[:3]
    return out

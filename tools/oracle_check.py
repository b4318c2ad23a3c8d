"""Run catalogue queries in Spark and their oracle SQL in DuckDB on the same
parquet tables and compare row count, column names, types and values
(order-insensitive). Usage: python tools/oracle_check.py [sf_dir] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quire.sources.io import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "tolist") and not hasattr(v, "__len__"):  # a number of numpy
        return _norm(v.tolist())
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    sp = query(spark, sf_dir).toPandas()
    t1 = time.time()
    dk = con.execute(sql).df()
    t2 = time.time()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dk)
    ok = sc == dc and len(sr) == len(dr) and sr == dr
    info = f"{name:24s} spark={len(sr):6d} ({t1 - t0:5.1f}s) duck={len(dr):6d} ({t2 - t1:5.1f}s) {'OK' if ok else 'MISMATCH'}"
    if not ok:
        if sc != dc:
            info += f"\n   cols spark={sc} duck={dc}"
        else:
            a, b = set(sr), set(dr)
            info += f"\n   only spark: {list(a - b)[:3]}\n   only duck:  {list(b - a)[:3]}"
    types = f"   spark types={dict(zip(sp.columns, map(str, sp.dtypes)))} duck types={dict(zip(dk.columns, map(str, dk.dtypes)))}"
    return ok, info, types


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from quire.plans.catalog import QUERIES
    from quire.plans.oracle import SQL
    from quire.session import build_session

    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for name, q in QUERIES.items():
        if names and name not in names:
            continue
        if name not in SQL:
            print(f"{name:24s} (no oracle)")
            continue
        try:
            ok, info, types = compare(spark, con, name, q, SQL[name], sf_dir)
        except Exception as e:  # report and continue
            ok, info, types = False, f"{name:24s} ERROR {type(e).__name__}: {str(e)[:800]}", ""
        print(info, flush=True)
        if not ok or os.environ.get("SHOW_TYPES"):
            print(types)
        bad += 0 if ok else 1
    print(f"mismatches: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

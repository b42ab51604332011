"""Compare every registered query with its DuckDB oracle on one data folder.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from inboxlake.sources.tables import DRIVER_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (list, dict, str)):
        try:
            return _norm(v.item())
        except Exception:
            return v
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    from inboxlake.plans.catalog import oracle_sql, queries
    qs, os_ = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            spd = sdf.toPandas()
            ts = time.time() - t0
            if name not in os_:
                results[name] = ("rows-only", len(spd), ts)
                if verbose:
                    print(f"{name:34s} rows-only   rows={len(spd)} {ts:.1f}s", flush=True)
                continue
            opd = con.execute(os_[name]).df()
            ok_cols = sorted(spd.columns) == sorted(opd.columns)
            ok_n = len(spd) == len(opd)
            ok_v = ok_cols and ok_n and rows_of(spd) == rows_of(opd)
            status = "OK" if ok_v else "MISMATCH"
            results[name] = (status, len(spd), ts)
            if verbose:
                print(f"{name:34s} {status:9s} spark={len(spd)} duck={len(opd)} {ts:.1f}s", flush=True)
                if not ok_cols:
                    print("   spark cols", sorted(spd.columns), "\n   duck  cols", sorted(opd.columns))
                elif not ok_v:
                    a, b = rows_of(spd), rows_of(opd)
                    diff_a = [r for r in a if r not in set(b)][:3]
                    diff_b = [r for r in b if r not in set(a)][:3]
                    print("   cols", sorted(spd.columns))
                    print("   spark-only", diff_a)
                    print("   duck-only ", diff_b)
        except Exception as e:  # report and go on
            results[name] = ("ERROR", 0, time.time() - t0)
            if verbose:
                print(f"{name:34s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
    return results


if __name__ == "__main__":
    from inboxlake.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session()
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows-only")]
    print("FAILED:", bad)

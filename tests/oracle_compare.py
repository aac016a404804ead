"""Run each registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Comparison: same row count, same column names, and equal values after
sorting rows (floats within a relative 1e-9).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm_val(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat") and not isinstance(v, str):
        try:
            import pandas as pd
            v = pd.Timestamp(v).tz_localize(None) if getattr(pd.Timestamp(v), "tzinfo", None) else pd.Timestamp(v)
            return v.isoformat()
        except Exception:
            return str(v)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, v) if isinstance(v, (int, float)) else (2, str(v)) for v in row)


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, bool) or isinstance(b, bool):
        return bool(a) == bool(b)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        if math.isinf(a) or math.isinf(b):
            return a == b
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark_df, duck_df):
    s_cols = sorted(spark_df.columns)
    d_cols = sorted(duck_df.columns)
    if s_cols != d_cols:
        return f"columns differ: spark={s_cols} duck={d_cols}"
    srows = [tuple(_norm_val(r[c]) for c in s_cols) for r in spark_df.to_dict("records")]
    drows = [tuple(_norm_val(r[c]) for c in d_cols) for r in duck_df.to_dict("records")]
    if len(srows) != len(drows):
        return f"row count spark={len(srows)} duck={len(drows)}"
    srows.sort(key=_key)
    drows.sort(key=_key)
    bad = 0
    first = None
    for a, b in zip(srows, drows):
        if not all(_close(x, y) for x, y in zip(a, b)):
            bad += 1
            first = first or (a, b)
    if bad:
        return f"{bad} rows differ; first: spark={first[0]} duck={first[1]}"
    return None


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from txnrisk.session import get_session
    import __spark_entry__ as entry
    spark = get_session()
    con = duck(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            failures += 1
            continue
        t1 = time.time()
        if name not in oracle:
            print(f"ROWS {name}: {len(sdf)} rows ({t1 - t0:.1f}s)")
            continue
        try:
            ddf = con.execute(oracle[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            failures += 1
            continue
        msg = compare(sdf, ddf)
        if msg:
            failures += 1
            print(f"FAIL {name}: {msg}")
        else:
            print(f"OK   {name}: {len(sdf)} rows ({t1 - t0:.1f}s)")
    print(f"failures: {failures}")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

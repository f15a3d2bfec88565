"""Compare a registered Spark query with its DuckDB oracle.

Row count, sorted column names and an order-insensitive multiset of
canonicalised rows (floats by repr, so any last-bit difference shows).
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

from dispute_engine.sources.fixtures import BASE_TABLES


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((canon(k), canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_multiset(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_names = df.columns
    s_rows = df.collect()
    t1 = time.time()
    if sql is None:
        return {"key": key, "status": "rows-only", "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    cur = con.execute(sql)
    d_names = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    t2 = time.time()
    out = {"key": key, "rows": len(s_rows), "oracle_rows": len(d_rows), "spark_s": round(t1 - t0, 2),
           "duck_s": round(t2 - t1, 2)}
    if sorted(s_names) != sorted(d_names):
        out.update(status="schema", spark_cols=sorted(s_names), oracle_cols=sorted(d_names))
        return out
    a, b = rows_multiset(s_names, s_rows), rows_multiset(d_names, d_rows)
    if a == b:
        out["status"] = "match"
    else:
        out["status"] = "values"
        out["only_spark"] = list((a - b).elements())[:3]
        out["only_oracle"] = list((b - a).elements())[:3]
        out["cols"] = sorted(s_names)
    return out


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from dispute_engine.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = get_spark()
    con = duck_connect(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for k in (keys or list(qs)):
        try:
            r = compare(spark, con, k, qs[k], os_.get(k), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "status": "error", "error": f"{type(e).__name__}: {str(e)[:600]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"done: {bad} not matching", flush=True)


if __name__ == "__main__":
    main(sys.argv)

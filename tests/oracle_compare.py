"""Run every ``queries()`` key in Spark and its ``oracle_sql()`` in DuckDB; compare results.

Usage: ``python tests/oracle_compare.py [sf_dir] [key ...]``. Prints one line per key and a
summary. The comparison mirrors the driver's: same column names, same row count, and the same
multiset of rows (values normalised: floats rounded to 9 significant digits, timestamps and
decimals as text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from clickfold.session import build_session

    spark = build_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    ok, bad = [], []
    for key in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[key](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if key not in sqls:
                print(f"{key:38s} rows={len(rows):6d} (no oracle) {t1 - t0:.2f}s")
                continue
            res = con.execute(sqls[key])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            t2 = time.time()
            problems = []
            if sorted(cols) != sorted(dcols):
                problems.append(f"columns spark={sorted(cols)} duck={sorted(dcols)}")
            if len(rows) != len(drows):
                problems.append(f"rows spark={len(rows)} duck={len(drows)}")
            if not problems and canon(cols, rows) != canon(dcols, drows):
                a, b = canon(cols, rows), canon(dcols, drows)
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                problems.append(f"values differ, e.g. {diff}")
            status = "OK " if not problems else "BAD"
            (ok if not problems else bad).append(key)
            print(f"{status} {key:38s} rows={len(rows):6d} spark={t1 - t0:.2f}s duck={t2 - t1:.2f}s {'; '.join(problems)}")
        except Exception as exc:  # noqa: BLE001
            bad.append(key)
            print(f"ERR {key:38s} {type(exc).__name__}: {str(exc)[:400]}")
    print(f"summary: {len(ok)} ok, {len(bad)} bad: {bad}")
    return 0 if not bad else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))

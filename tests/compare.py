"""Run registered queries against DuckDB and compare whole results.

    python tests/compare.py [--sf 0.001] [name ...]
"""

from __future__ import annotations

import argparse
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def norm(v, digits=None):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return tuple(norm(x, digits) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits else v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def canon(rows, digits=None):
    return sorted((tuple(norm(v, digits) for v in r) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()], dict(df.dtypes)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in cur.fetchall()], types


_SAME = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    cols, got, types = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    if sql is None:
        return "rows-only", len(got), t1 - t0, 0.0
    dcols, want, dtypes = duck_rows(con, sql)
    t2 = time.time()
    if cols != dcols:
        return f"COLUMNS {cols} != {dcols}", len(got), t1 - t0, t2 - t1
    bad = [(c, types[c], dtypes[c]) for c in cols if types[c] in _SAME and _SAME[types[c]] != dtypes[c]]
    note = f" TYPES {bad}" if bad else ""
    a, b = canon(got), canon(want)
    if a == b:
        return "ok" + note, len(got), t1 - t0, t2 - t1
    if canon(got, 9) == canon(want, 9):
        return "CLOSE (not exact)" + note, len(got), t1 - t0, t2 - t1
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return (f"DIFF spark={len(a)} duck={len(b)} only-spark={sorted(sa - sb)[:3]} only-duck={sorted(sb - sa)[:3]}" + note,
            len(got), t1 - t0, t2 - t1)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.001")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from visiontables.session import local_session

    spark = local_session(8)
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    total = time.time()
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            status, n, ts, td = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # report and go on with the next query
            status, n, ts, td = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0, 0, 0
        bad = status not in ("ok", "rows-only")
        failed += bad
        print(f"{'!!' if bad else '  '} {name:34s} {n:8d} rows  spark {ts:6.2f}s duck {td:6.2f}s  {status}", flush=True)
    print(f"failed: {failed}, total {time.time() - total:.0f}s")


if __name__ == "__main__":
    main()

"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

    python tests/check_oracle.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value):
    return "none" if value is None else type(value).__name__


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(plain(r[c]) for c in cols) for r in df.collect()]


def duck_rows(folder, sql):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]


def compare(spark_result, duck_result):
    (c1, r1), (c2, r2) = spark_result, duck_result
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}"
    key = lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, tuple) else (False, "t", str(v)) for v in r)
    s1, s2 = sorted(r1, key=key), sorted(r2, key=key)
    for a, b in zip(s1, s2):
        if a != b or [kind(v) for v in a] != [kind(v) for v in b]:
            return f"first difference in {c1}\n   spark {a}\n   duck  {b}"
    return None


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from trapline.session import local_session

    spark = local_session("check", "8")
    oracles = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if args.names and not any(part in name for part in args.names):
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, args.sf))
            took = time.time() - start
            if not got[1]:
                error = "no rows"
            else:
                error = compare(got, duck_rows(args.sf, oracles[name])) if name in oracles else None
        except Exception as e:  # noqa: BLE001
            took, error, got = time.time() - start, f"{type(e).__name__}: {str(e)[:1500]}", (0, [])
        label = "ok  " if error is None else "BAD "
        print(f"{label} {name:48s} {len(got[1]):7d} rows {took:6.2f}s {'' if name in oracles else '(rows only)'}", flush=True)
        if error:
            print("   ", error, flush=True)
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()

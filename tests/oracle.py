"""Run registered queries against their SQL on the same tables and compare schema kind, row count and every value.

Usage: ``python -m tests.oracle [sf] [name-prefix ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.environ.get("TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/sf{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    return f"{type(value).__name__}:{value!r}"


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(frame, con, sql):
    left = normal(frame.columns, [tuple(r) for r in frame.collect()])
    found = con.execute(sql)
    right = normal([d[0] for d in found.description], found.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", len(left[1])
    if len(left[1]) != len(right[1]):
        extra = sorted(set(left[1]) - set(right[1]))[:2], sorted(set(right[1]) - set(left[1]))[:2]
        return f"rows {len(left[1])} != {len(right[1])}: {str(extra)[:1500]}", len(left[1])
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. {str(bad[0][0])[:700]} != {str(bad[0][1])[:700]}", len(left[1])
    return None, len(left[1])


def main(argv):
    sf = argv[0] if argv else "0.001"
    from lectern.session import local_session
    import __spark_entry__ as entry
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        started = time.time()
        try:
            frame = fn(spark, f"{ROOT}/sf{sf}")
            if name in oracles:
                error, n = compare(frame, con, oracles[name])
            else:
                error, n = None, frame.count()
        except Exception as exc:
            error, n = f"{type(exc).__name__}: {str(exc)[:1200]}", -1
        failed += error is not None
        print(f"{'FAIL' if error else 'ok  '} {name:40s} {n:8d} {time.time() - started:6.1f}s{'' if name in oracles else '  (no sql)'}"
              + (f"\n     {error}" if error else ""), flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

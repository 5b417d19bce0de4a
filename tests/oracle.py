"""Run queries next to their SQL and compare rows regardless of order.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, fn, sql, folder):
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1])
    con.execute(sql)
    want = rows_of([d[0] for d in con.description], con.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}", len(got[1])
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    kinds = [(type(g), type(w)) for g, w in zip(got[1][0], want[1][0])] if got[1] else []
    mixed = [c for c, (a, b) in zip(got[0], kinds) if a is not b and type(None) not in (a, b)]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}", len(got[1])
    return (f"types differ in {mixed}" if mixed else None), len(got[1])


def main(argv):
    import __spark_entry__ as entry
    from puckspark.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, fn, oracle.get(name), folder)
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        note = problem or ("ok" if name in oracle else "ok (no SQL)")
        print(f"{name:32s} {n:8d} rows {time.time() - start:6.2f}s  {note}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

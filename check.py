"""Run registered queries against their SQL on one scale factor: ``python check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np

from opsinlake.catalog import REGISTRY
from opsinlake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _canon(df):
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple(
            None if v is None or (isinstance(v, float) and np.isnan(v)) else (float(v) if isinstance(v, (int, float, np.number)) else str(v))
            for v in row
        ))
    return sorted(rows, key=repr)


def compare(spark, con, sf: str, name: str):
    """(problem or None, rows, Spark seconds)."""
    fn, sql = REGISTRY[name]
    start = time.time()
    got = fn(spark, sf).toPandas()
    took = time.time() - start
    if sql is None:
        return (None if len(got) else "no rows"), len(got), took
    want = con.execute(sql()).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", len(got), took
    a, b = _canon(got), _canon(want)
    if len(a) != len(b):
        return f"{len(a)} rows, SQL has {len(b)}", len(got), took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}", len(got), took
    return (None if len(got) else "no rows"), len(got), took


def main(argv):
    sf = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark, con, failed = local_session(8), connect(sf), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in argv[1:] or REGISTRY:
        try:
            problem, rows, took = compare(spark, con, sf, name)
        except Exception as e:  # keep going, report at the end
            problem, rows, took = f"{type(e).__name__}: {str(e)[:700]}", 0, 0.0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32s} {rows:7d} rows {took:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

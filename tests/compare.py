"""Run queries and their SQL side by side: python tests/compare.py [dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(spark, con, name, query, sql, sf_dir) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = _rows([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    if not got:
        return "no rows at all"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = [
        (c, type(a).__name__, type(b).__name__)
        for g, w in zip(got, want)
        for c, a, b in zip(got_cols, g, w)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    if bad:
        return f"{len(bad)} of {len(got)} rows, first {bad[0]}"
    if types:
        return f"types {types[0]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tests.session import make_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        t = time.time()
        try:
            if name in oracles:
                problem = differences(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows at all"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{failed} of {len(args or queries)} differ")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

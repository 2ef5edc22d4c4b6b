"""Compare registered queries with their SQL: python tests/check_queries.py [sf] [names…]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return str(v) if v is not None and not isinstance(v, (bool, int, str)) else v


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} != {sorted(rel.columns)}"
    mine = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    at = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if mine == theirs:
        return None
    left, right = list((mine - theirs).items())[:2], list((theirs - mine).items())[:2]
    return f"rows {sum(mine.values())} / {sum(theirs.values())}; only here {left}; only there {right}; {names}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from daftar.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, con, bad = local_session("check"), connect(sf), 0
    sqls = oracle_sql()
    for name, fn in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            said = compare(fn(spark, sf), con, sqls[name]) if name in sqls else f"no sql, {fn(spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:700]}"
        bad += said is not None
        print(f"{name:28s} {time.time() - start:6.1f}s {'ok' if said is None else said[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())

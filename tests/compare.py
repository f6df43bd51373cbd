"""Compare every query with its SQL on one scale; also a script: python tests/compare.py [sf] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float) and not math.isnan(v):
            return repr(v)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check(spark, con, name, query, sql, sf_dir, inspect=None) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    if inspect:
        inspect(df)
    got = df.collect()
    t1 = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    t2 = time.time()
    timing = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}; {timing}"
    a, b = canonical(got, df.columns), canonical(want, names)
    if a == b:
        return True, timing
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return False, f"{timing}; {len(a)} vs {len(b)}\n  spark {only_a}\n  sql   {only_b}\n  {sorted(names)}"


if __name__ == "__main__":
    from loopledger.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    oracle, bad = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            if name in oracle:
                ok, text = check(spark, con, name, query, oracle[name], sf_dir)
            else:
                ok, text = True, f"no sql; {query(spark, sf_dir).count()} rows"
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print("ok  " if ok else "FAIL", name, text, flush=True)
        bad += [] if ok else [name]
    print("failed:", bad)

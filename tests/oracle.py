"""Runs queries against DuckDB: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]",
    "array<double>": "DOUBLE[]", "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if isinstance(v, list):
        return [_key(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "null" if v is None else str(v)


def differences(df, con, sql: str) -> list[str]:
    """Problems found when comparing a Spark result with its SQL twin."""
    rel = con.sql(sql)
    names, types = list(rel.columns), [str(t) for t in rel.types]
    theirs = [tuple(r) for r in rel.fetchall()]
    ours = [tuple(r) for r in df.collect()]
    cols = sorted(df.columns)
    out = []
    if cols != sorted(names):
        return [f"columns {cols} != {sorted(names)}"]
    spark_types = dict(df.dtypes)
    for n, t in zip(names, types):
        if SAME_TYPE.get(spark_types[n]) != t:
            out.append(f"type of {n}: {spark_types[n]} != {t}")
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    a = sorted([_key(r[df.columns.index(c)]) for c in cols] for r in ours)
    b = sorted([_key(r[names.index(c)]) for c in cols] for r in theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} of {len(a)} rows differ, first {bad[0]} {cols}")
    return out


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from fieldtrial.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sql = connect(sf_dir), queries(), oracle_sql()
    wanted = sys.argv[2:] or list(qs)
    wanted = [q for q in qs if any(q.startswith(w) for w in wanted)]
    failed = 0
    for name in wanted:
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sql:
                problems = differences(df, con, sql[name])
            else:
                problems = [] if df.count() >= 0 else ["no rows"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in sql else "ok (rows only)")
        print(f"{mark:5s} {name} {time.time() - t:.1f}s", *problems, sep="\n      " if problems else " ", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} passed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Run registered queries beside their SQL in DuckDB and compare the rows.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldspark.fixtures import NAMES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    return con


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(v + 0.0 if v else 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return f"{type(v).__name__}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(df, con, sql):
    """None when equal, else what differs."""
    got = [tuple(x) for x in df.collect()]
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} against {names}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main(argv):
    from fieldspark.catalog import REGISTRY
    from fieldspark.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:] or list(REGISTRY)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in wanted:
        q = REGISTRY[name]
        start = time.time()
        try:
            if q.sql is None:
                problem, note = None, f"rows only: {len(q.run(spark, sf_dir).collect())}"
            else:
                problem, note = compare(q.run(spark, sf_dir), con, q.sql), ""
        except Exception as e:  # noqa: BLE001
            problem, note = f"{type(e).__name__}: {str(e)[:600]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {time.time() - start:6.2f}s {problem or note}", flush=True)
        if problem:
            failed.append(name)
    print(len(wanted) - len(failed), "of", len(wanted), "agree; failed:", " ".join(failed))
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))

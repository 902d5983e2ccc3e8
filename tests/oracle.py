"""Run registered queries on Spark and their SQL on DuckDB, and compare.

python tests/oracle.py <data folder> [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TIMES = {"spark": 0.0}


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, repr(round(value, 6) + 0.0))
    return (3, str(value))


def _shape(kind: str) -> str:
    kind = kind.lower()
    known = {"bigint": "long", "integer": "int", "varchar": "string", "double": "double", "boolean": "bool",
             "string": "string", "int": "int", "tinyint": "byte"}
    return known.get(kind, kind)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    began = time.time()
    rows = spark_df.collect()
    TIMES.update(spark=time.time() - began, rows=len(rows))
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: _shape(str(d[1])) for d in result.description}
    want = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    got_kinds = {f.name: _shape(f.dataType.simpleString()) for f in spark_df.schema.fields}
    got_kinds = {n: {"bigint": "long", "boolean": "bool"}.get(k, k) for n, k in got_kinds.items()}
    odd = {n: (got_kinds[n], kinds[n]) for n in names if got_kinds[n] != kinds[n]}
    order = sorted(names)
    got = sorted(tuple(_cell(r[n]) for n in order) for r in rows)
    at = [names.index(n) for n in order]
    want = sorted(tuple(_cell(r[i]) for i in at) for r in want)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference in {order}:\n  spark {str(g)[:600]}\n  sql   {str(w)[:600]}"
    return f"types {odd}" if odd else None


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from lorebase.session import local_session

    spark = local_session(8)
    con = connect(folder)
    checks, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in checks:
                problem = compare(df, con, checks[name])
                rows = "checked"
            else:
                rows, problem = f"{df.count()} rows, no SQL", None
        except Exception as exc:  # report and go on
            rows, problem = "", f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - start:6.2f}s {rows} (run {TIMES['spark']:.2f}s, {TIMES.get('rows')} rows) {problem or ''}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1].rstrip("/"), sys.argv[2:])))

"""Compare queries with their SQL: python -m workload.check FOLDER [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from workload import load

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type -> DuckDB type.
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def _rows(rows, order):
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs; empty if nothing does."""
    names = df.columns
    got = df.collect()
    cur = con.execute(sql)
    described = cur.description
    want_names = [d[0] for d in described]
    want = cur.fetchall()
    problems = []
    if sorted(names) != sorted(want_names):
        return [f"columns {sorted(names)} != {sorted(want_names)}"]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want_order = sorted(range(len(names)), key=lambda i: want_names[i])
    for i, j in zip(order, want_order):
        kind = df.schema[i].dataType.simpleString()
        if SAME.get(kind) != str(described[j][1]):
            problems.append(f"type of {names[i]}: {kind} != {described[j][1]}")
    a, b = _rows(got, order), _rows(want, want_order)
    if len(a) != len(b):
        problems.append(f"{len(a)} rows != {len(b)}")
    in_a, in_b = Counter(a), Counter(b)
    only_a, only_b = list((in_a - in_b).elements()), list((in_b - in_a).elements())
    if only_a or only_b:
        problems.append(f"{len(only_a)}/{len(only_b)} rows differ\n   spark {only_a[:3]}\n   duck  {only_b[:3]}")
    if not a:
        problems.append("no rows")
    return problems


def run(spark: SparkSession, folder: str, names: list[str]) -> int:
    queries, oracles = load()
    con = connect(folder)
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                n = df.count()
                problems = [] if n else ["no rows"]
        except Exception as e:  # report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:900]}"]
        note = "" if name in oracles else " (rows only)"
        if problems:
            bad += 1
            print(f"FAIL {name}{note} {time.time() - start:.1f}s")
            for p in problems:
                print("  ", p)
        else:
            print(f"ok   {name}{note} {time.time() - start:.1f}s")
    print(f"{len(names or queries) - bad} ok, {bad} failed")
    return bad


if __name__ == "__main__":
    from workload.session import local_session

    sys.exit(1 if run(local_session(), sys.argv[1], sys.argv[2:]) else 0)

"""Run registered queries against their DuckDB statements: python tests/oracle.py SF [prefix ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    try:
        return float(value)
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in data]
    return sorted(out, key=repr), [columns[i] for i in order]


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark_df, con, sql):
    got = spark_df.collect()
    left, lcols = rows_of(spark_df.columns, got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right, rcols = rows_of(names, cur.fetchall())
    if lcols != rcols:
        return f"columns {lcols} != {rcols}", len(left)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}", len(left)
    return None, len(left)


def main():
    from vanflow.session import get_spark
    import __spark_entry__ as entry

    sf = sys.argv[1]
    prefixes = tuple(sys.argv[2:])
    spark = get_spark(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                problem, n = None, len(df.collect())
        except Exception as exc:  # report and go on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:400]}", -1
        tag = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        failures += bool(problem)
        print(f"{tag} {name} rows={n} {time.time() - t0:.1f}s {problem or ''}", flush=True)
    print("failures:", failures)


if __name__ == "__main__":
    main()

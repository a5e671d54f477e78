"""Compares registered queries with their DuckDB SQL on one folder of tables.

Run as ``python tests/oracle_check.py [sf] [query ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in values)


def compare(spark, con, build, sql, sf_dir):
    """Returns (problem or None, number of rows)."""
    frame = build(spark, sf_dir)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}", len(got)
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{len(got)} vs {len(want)} rows\n   spark only {extra}\n   sql only   {missing}", len(got)
    return None, len(got)


def main() -> None:
    from pyspark.sql import SparkSession

    from reviewloom.catalog import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = sf if "/" in sf else f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem, n = compare(spark, con, build, sqls[name], sf_dir)
            else:
                problem, n = None, build(spark, sf_dir).count()
        except Exception as error:  # keep going, report at the end
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        note = "" if name in sqls else " (no sql)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{note} rows={n} {time.time() - start:.1f}s"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()

"""Compare registered queries with their SQL on one folder of tables: ``python tests/oracle.py FOLDER [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def normal(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    return x


def rows_of(columns: list[str], rows: list) -> list[str]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([normal(r[i]) for i in at]) for r in rows)


def compare(spark, con, folder: str, name: str, query, sql: str) -> str | None:
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} and {rel.columns}"
    if got != want:
        return f"{len(got)} rows and {len(want)}; only here {sorted(set(got) - set(want))[:3]}, only there {sorted(set(want) - set(got))[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    folder, names = sys.argv[1], sys.argv[2:]
    con, sql, bad = views(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names or name not in sql and not names:
            continue
        begin = time.time()
        try:
            wrong = compare(spark, con, folder, name, query, sql[name])
        except Exception as e:  # noqa: BLE001  every query is reported
            wrong = f"{type(e).__name__}: {str(e)[:300]}"
        bad += wrong is not None
        print(f"{name}: {wrong or 'same'} ({time.time() - begin:.1f} s)", flush=True)
    sys.exit(bad > 0)

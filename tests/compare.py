"""Runs queries beside their SQL and compares the rows; also a command: python -m tests.compare SF [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return v if math.isnan(v) else (float(f"{v:.9g}"))  # no NaN equals another, so a query and its SQL must give null instead
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if ours != theirs:
        a, b = set(map(repr, ours)), set(map(repr, theirs))
        return f"{len(ours)} rows against {len(theirs)}; only ours {sorted(a - b)[:3]}; only SQL's {sorted(b - a)[:3]}"
    return ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-checkpoint-")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark, sf = session(), sys.argv[1]
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            if name in sqls:
                said = compare(spark, sf, query, sqls[name]) or "same"
            else:
                said = f"{query(spark, sf).count()} rows, no SQL"
        except Exception as e:
            said = f"ERROR {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)

"""Runs a registered query in Spark and its SQL in DuckDB, and compares the rows.

``python tests/compare.py [sf] [name prefix...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = "/root/testdata"


def session(cpus="8", memory="12g"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foldwise-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else float(f"{v:.12g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in data]
    rows.sort(key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
    return [columns[i] for i in order], rows


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return columns, cur.fetchall()


def compare(spark, name, fn, sql, sf_dir):
    """None when equal, otherwise a short account of the difference."""
    df = fn(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "NestedLoopJoin" in plan or "CartesianProduct" in plan:
        return "the plan pairs rows without a key"
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    want_cols, want = _rows(*oracle(sql, sf_dir))
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first {got[:1]} against {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, {got_cols}: {bad[0][0]} against {bad[0][1]}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    spark = session()
    failed = []
    sqls = oracle_sql()
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, name, fn, sqls.get(name), f"{ROOT}/sf{sf}")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in sqls else '(no sql)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

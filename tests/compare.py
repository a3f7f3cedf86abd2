"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import glob
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        if name in TABLES:
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def _value(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def _lines(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql, sf_dir) -> tuple[str | None, int, float, float]:
    """(what differs or None, rows, seconds in Spark, seconds in SQL)."""
    started = time.time()
    df = query(spark, sf_dir)
    columns = df.columns
    ours = _lines([tuple(r) for r in df.collect()], columns)
    spark_seconds = time.time() - started
    started = time.time()
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    theirs = _lines(result.fetchall(), sql_columns)
    sql_seconds = time.time() - started
    problem = None
    if sorted(columns) != sorted(sql_columns):
        problem = f"columns {sorted(columns)} / {sorted(sql_columns)}"
    elif len(ours) != len(theirs):
        problem = f"{len(ours)} rows / {len(theirs)}"
    else:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        if bad:
            problem = f"{len(bad)} rows differ, such as {bad[0]}"
    return problem, len(ours), spark_seconds, sql_seconds

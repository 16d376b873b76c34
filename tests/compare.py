"""Run queries and their SQL twins side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree in columns, row count and values."""
    df = query(spark, sf_dir)
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    other, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != other:
        return f"columns {names} != {other}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, e.g. {bad[:2]}"
    types = {n: {type(r[i]) for r in mine} - {type(None)} for i, n in enumerate(names)}
    other_types = {n: {type(r[i]) for r in theirs} - {type(None)} for i, n in enumerate(names)}
    return None if types == other_types else f"types {types} != {other_types}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from tripline.queries import oracle_sql, queries

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    chosen = sys.argv[2:] or list(queries())
    spark, con = session(), connect(sf)
    for name in chosen:
        began = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql is None:
                n = queries()[name](spark, sf).count()
                verdict = f"rows only: {n}"
            else:
                found = difference(spark, con, queries()[name], sql, sf)
                verdict = "ok" if found is None else f"DIFFERS {found}"
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {str(e)[:600]}"
        print(f"{name}: {verdict} ({time.time() - began:.1f}s)", flush=True)

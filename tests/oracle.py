"""Runs a query and its SQL side by side: rows as multisets, columns by name."""

from __future__ import annotations

import os
import sys
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            at = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{t}.parquet") else "")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def compare(df, sf_dir: str, sql: str) -> list[str]:
    """What differs; empty if nothing does."""
    names, rows = duck(sf_dir, sql)
    order = sorted(names)
    if order != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {order}"]
    mine = Counter(tuple(canon(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(canon(r[names.index(c)]) for c in order) for r in rows)
    if mine == theirs:
        return []
    return [f"rows {sum(mine.values())} and {sum(theirs.values())}", f"only Spark {list((mine - theirs).items())[:3]}", f"only SQL {list((theirs - mine).items())[:3]}"]


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    names = sys.argv[2:] or list(e.queries())
    for n in names:
        t = time.time()
        df = e.queries()[n](spark, sf)
        sql = e.oracle_sql().get(n)
        if sql:
            said = compare(df, sf, sql)
            print(n, "OK" if not said else said, df.count() if not said else "", round(time.time() - t, 1), flush=True)
        else:
            print(n, "rows", df.count(), round(time.time() - t, 1), df.columns, flush=True)

"""Holds queries against their SQL twins: python -m tests.compare [folder] [name...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v) if math.isinf(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return tuple(map(cell, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) > 1 << 53 else str(v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def difference(df, con, sql: str) -> str:
    """What differs, or nothing."""
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs = normal([d[0] for d in found.description], found.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows: {[r for r in ours[1] if r not in theirs[1]][:3]} {[r for r in theirs[1] if r not in ours[1]][:3]}"
    return next((f"{a} and {b}" for a, b in zip(ours[1], theirs[1]) if a != b), "")


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    folder, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = connection(folder), entry.oracle_sql()
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = f(spark, folder)
            said = difference(df, con, sqls[name]) if name in sqls else f"{df.count()} rows, no SQL"
        except Exception as x:
            said = f"ERROR {type(x).__name__}: {str(x)[:400]}"
        print(f"{'ok  ' if not said else 'note' if said.endswith('no SQL') else 'BAD '} {time.time() - began:6.2f} {name} {said[:600]}", flush=True)


if __name__ == "__main__":
    main()

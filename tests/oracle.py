"""Runs queries beside their SQL, the way the driver compares them."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings terms sources names mentions requests fields review_labels chunk_limits catalog_aliases mix_targets".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(value, x)) + "]"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def both(spark, con, folder, query, sql):
    """(columns and rows of Spark, columns and rows of SQL)"""
    df = query(spark, folder)
    got = sorted(df.columns), rows(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return got, (sorted(cols), rows(cols, cur.fetchall()))

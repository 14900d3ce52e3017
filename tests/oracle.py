"""Runs SQL on the same tables and compares rows, whatever their order."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(c) for c in names]
    return names, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)

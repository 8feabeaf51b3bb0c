"""Comparison of a query with its DuckDB oracle: names, rows and values, in any order."""

import duckdb
import pandas as pd

from tallyport.plans.registry import TABLES


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return "~"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, str):
        return x
    try:
        return str(round(float(x), 9))
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(x) for x in r) for r in df[names].astype(object).itertuples(index=False, name=None))


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    return con


def same(spark, folder, query, sql):
    assert rows(query(spark, folder).toPandas()) == rows(connect(folder).sql(sql).df())

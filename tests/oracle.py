"""Comparing a query with its SQL on DuckDB."""

import os

import duckdb
import pandas as pd


def rows_of(sql: str, d: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    return con.sql(sql).df()


def _value(x):
    if x is None or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (str, bool)):
        return x
    return round(float(x), 5)


def normal(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(_value, r))) for r in df.itertuples(index=False, name=None))

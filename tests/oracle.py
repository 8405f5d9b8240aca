"""Results of a query against those of its SQL."""

import os

import duckdb
import numpy as np
import pandas as pd


def connect(directory):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(directory):
        path = f"{directory}/{f}"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("Int"):
            df[c] = df[c].astype("float64" if df[c].isna().any() else "int64")
        if df[c].dtype.kind == "f":
            df[c] = df[c].map(lambda x: "nan" if pd.isna(x) else repr(float(x)))
        else:
            df[c] = df[c].map(lambda x: "null" if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else str(x))
    return sorted(map(tuple, df.values.tolist()))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, f"only in the result: {sorted(set(a) - set(b))[:3]}; only in the SQL: {sorted(set(b) - set(a))[:3]}"

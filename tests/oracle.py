"""Running a query's SQL on the same parquet tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        src = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{src}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and pd.isna(x)) or x is pd.NaT:
        return "~"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def normal(df):
    """Columns by name, cells as text, rows sorted."""
    df = df[sorted(df.columns)].astype(object)
    df = df.map(_cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)

"""Runs a query's SQL in DuckDB and compares both results as multisets of rows."""

import glob
import os

import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def views(sf=SF):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, pd.Timestamp):
        return str(v)
    return canon(v.item()) if hasattr(v, "item") else v


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)

"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import os

import duckdb
import pandas as pd


def rows(frame, columns):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(str(tuple(map(cell, r))) for r in frame[columns].astype(object).values.tolist())


def assert_same(spark, query, sql, sf_dir):
    out = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    expected = con.execute(sql).df()
    columns = sorted(out.columns)
    assert columns == sorted(expected.columns)
    assert rows(out, columns) == rows(expected, columns)

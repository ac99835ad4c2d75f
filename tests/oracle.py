"""Compares a query with DuckDB's answer to its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd


def rows(frame):
    def plain(x):
        if pd.isna(x):
            return None
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.values.tolist()), key=str)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

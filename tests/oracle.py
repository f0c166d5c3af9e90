"""Comparison of a query with its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd


def same(query, sql, spark, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(sql).fetchdf()
    got = query(spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert len(want) == len(got)
    columns = sorted(want.columns)
    if len(want):
        a, b = want[columns], got[columns]
        a, b = (x.sort_values(columns).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1e-9)

"""The queries of the subpackage that SQL can express, against their SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from taxaspark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_text = lambda df: df[sorted(df.columns)].astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(as_text(got), as_text(want))

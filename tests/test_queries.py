"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from taxaspark import fixed, learning, queries  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "NULL" if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)) else repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, db, name):
    pd.testing.assert_frame_equal(normal(queries.QUERIES[name](spark, DATA).toPandas()), normal(db.sql(queries.ORACLE[name]).df()))


@pytest.mark.parametrize("name", sorted(set(learning.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert learning.QUERIES[name](spark, DATA).count() > 0


def test_stream_learns_as_the_batch(spark):
    batch = {(r["tree"], r["position"]): r["score"] for r in learning.prequential_tree(spark, DATA).collect()}
    stream = sorted((r["tree"], r["order"], r["score"]) for r in learning.stream_fit(spark, DATA).collect())
    place = {}
    for tree, _, score in stream:
        k = place[tree] = place.get(tree, -1) + 1
        assert batch[tree, k] == score

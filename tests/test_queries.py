"""Each query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame()
    for c in sorted(frame.columns):
        x = frame[c]
        if pd.api.types.is_bool_dtype(x) or pd.api.types.is_numeric_dtype(x):
            out[c] = x.astype(float)
        elif pd.api.types.is_datetime64_any_dtype(x):
            out[c] = x.astype("datetime64[us]").astype(str)
        else:
            values = [None if v is None or v is pd.NA or v != v else v for v in x]
            out[c] = pd.Series(values, dtype=float) if all(v is None or isinstance(v, (bool, np.bool_)) for v in values) else pd.Series([str(v) for v in values], dtype=object)
    exact = [c for c in out if out[c].dtype == object or (out[c].dropna() % 1 == 0).all()]
    return out.sort_values([*exact, *[c for c in out if c not in exact]], ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = plain(QUERIES[name](spark, FOLDER).toPandas()), plain(duck.sql(ORACLE_SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours:
        if ours[c].dtype == object or theirs[c].dtype == object:
            assert ours[c].astype(str).tolist() == theirs[c].astype(str).tolist(), c
        else:
            np.testing.assert_allclose(ours[c], theirs[c], rtol=1e-6, atol=1e-6, err_msg=c)

"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from turbula import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiub" or str(df[c].dtype) in ("Int64", "boolean"):
            df[c] = df[c].astype(float)
        elif df[c].map(lambda v: isinstance(v, (bool, np.bool_)) or v is None).all():
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    ours = canonical(catalog.QUERIES[name](spark, SF).toPandas())
    theirs = canonical(duck.execute(catalog.ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, atol=2e-6, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0

"""Each query against its SQL on the smallest tables."""

import os
from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

from genoslate.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    number = lambda v: isinstance(v, Number) and not isinstance(v, (bool, np.bool_))
    cell = lambda v: "" if pd.isna(v) else (f"{float(v):.5f}" if number(v) else str(v))
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query with an SQL text gives the same rows in both engines."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cohortspark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: these need more rows than the smallest tables give them
LARGER = dict.fromkeys(["group_split_3way", "success_floor_guard", "one_hot"], "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    out = {}
    for folder in {SF, *LARGER.values()}:
        out[folder] = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            out[folder].execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return out


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(int(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return repr(round(float(x), 6) + 0.0)
    return str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x).removesuffix(" 00:00:00")


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].map(plain).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    folder = LARGER.get(name, SF)
    got, want = QUERIES[name](spark, folder).toPandas(), con[folder].execute(ORACLES[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

"""Every query with SQL, run on both engines over the smallest data."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from abacusflow.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].map(lambda v: hasattr(v, "isoformat")).any():
            frame[c] = pd.to_datetime(frame[c]).dt.strftime("%Y-%m-%d %H:%M:%S.%f")
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, wanted = plain(registry.queries()[name](spark, FOLDER).toPandas()), plain(duck.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(wanted.columns)
    assert len(got) == len(wanted)
    for c in got.columns:
        same = (got[c] == wanted[c]) | (got[c].isna() & wanted[c].isna())
        assert same.all(), (c, got[c][~same].head().tolist(), wanted[c][~same].head().tolist())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", ["invoice_match_one_to_one", "cascade_key_match", "obligation_match"])
def test_matches_are_one_to_one(spark, name):
    rows = registry.queries()[name](spark, FOLDER).where("debit is not null")
    assert rows.count() == rows.select("debit").distinct().count() == rows.select("invoice").distinct().count() > 0

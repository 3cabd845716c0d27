"""Every query that has SQL gives the same rows in both engines."""

import glob
import os

import duckdb
import pytest

from aerolith.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found)
    if name not in ORACLES:
        return
    wanted = con.execute(ORACLES[name]).df()
    columns = sorted(found.columns)
    assert sorted(wanted.columns) == columns
    found, wanted = (x[columns].sort_values(columns, ignore_index=True) for x in (found, wanted))
    assert len(found) == len(wanted)
    for c in columns:
        same = (found[c] == wanted[c]) | (found[c].isna() & wanted[c].isna())
        assert same.all(), (c, found[c][~same].head(3).tolist(), wanted[c][~same].head(3).tolist())
        assert found[c].dtype == wanted[c].dtype

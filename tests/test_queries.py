"""Every registered query of the timeline operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillon.plans.catalog import ORACLES, QUERIES

DATA = os.environ.get("QUILLON_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def clean(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = [tuple(clean(r[c]) for c in cols) for r in df.collect()]
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(clean(r[i]) for i in at)) for r in found.fetchall())

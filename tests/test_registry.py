"""Registered queries against the DuckDB oracle on the smallest scale (the driver checks sf0.01)."""

import math
import os

import pytest

from kpiframe.plans import registry

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as entry

    sdf = entry.queries()[name](spark, SF)
    srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == sorted(sdf.columns)
    idx = [dcols.index(c) for c in sdf.columns]
    drows = [tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(srows, key=key) == sorted(drows, key=key)


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["x", "position", "volume", "resp0_num", "resp0"]
    assert df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

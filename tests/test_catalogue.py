"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from termloom.plans import more_queries, parse_queries  # noqa: F401  add to the catalogue
from termloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in got.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in sorted(x.removesuffix(".parquet") for x in os.listdir(SF)):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = [want.columns.index(c) for c in got.columns]
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(rows, key=key) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)

"""Every query of the library's own operators against its SQL on the smallest tables."""

import duckdb
import pytest

from codesieve.jobs.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def comparable(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(r[i]) for i in at) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in SQL:
        assert rows
        return
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(rows, got.columns) == comparable(want.fetchall(), want.columns)

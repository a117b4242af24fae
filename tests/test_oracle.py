"""Every query with SQL against DuckDB on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quarryline.plans import analysis, records

SMALL = Path("/root/testdata/sf0.001")
SQL = {**analysis.SQL, **records.SQL}
QUERIES = {**analysis.QUERIES, **records.QUERIES}
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SMALL))
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(SMALL)).count() >= 0

"""Every core query with SQL against that SQL in DuckDB, over the smallest tables."""

import os

import pytest

from noticeloom.plans import registry
from noticeloom.sources.tables import TABLES

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c].asDict(True) if hasattr(r[c], "asDict") else r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns and mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).columns

"""Every llm query over the smallest tables; those with SQL against it."""

import os

import pytest

from noticeloom.llm import queries
from noticeloom.sources.tables import TABLES

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
COLUMNS = {
    "p1_found": ["tbl", "row_id"], "p3_found": ["src_doc_id", "line_no"], "p4_found": ["evidence_id"], "p5_found": ["place", "row_id", "pos", "pii_type"],
    "p7_found": ["src_doc_id", "line_no", "noise_kind"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_gives_each_row_once(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.queries()[name](spark, DATA)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == theirs

"""Every query with SQL equals DuckDB on the smallest tables; the others run. Data problems' queries of the core included."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import data_queries, signal_queries, view_queries

DIR = "/root/testdata/sf0.001"
QUERIES = signal_queries.QUERIES | view_queries.QUERIES | data_queries.QUERIES
ORACLE = signal_queries.ORACLE | view_queries.ORACLE | data_queries.ORACLE


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in glob.glob(DIR + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        cols = [x[0] for x in r.description]
        assert sorted(df.columns) == sorted(cols)
        assert norm(rows, df.columns) == norm(r.fetchall(), cols)


def test_leaders_and_validator_agree(spark):
    q = signal_queries
    lead = q.dedupe_greedy(spark, DIR)
    assert lead.filter("leader > seq").count() == 0
    heads = lead.filter("leader = seq").count()
    assert q.merge_duplicates(spark, DIR).count() == heads

import datetime as dt

import pytest

from tidemark.operators import references as R

T = dt.datetime(2026, 1, 10)


def tables(spark):
    dim = "id string, parent string, added_at timestamp, removed_at timestamp, key int, ref_id string"
    old, late = dt.datetime(2025, 1, 1), dt.datetime(2026, 2, 1)
    companies = [("a", None, old, None, 0, "x"), ("b", "gone", old, None, 0, "x"), ("c", "b", old, None, 0, "x"), ("d", "c", old, T, 0, "x"), ("e", None, late, None, 0, "x"), ("r", "s", old, None, 0, "x"), ("s", "r", old, None, 0, "x")]
    companies += [("e2", None, late, None, 0, "x"), ("e2", None, old, late, 0, "x")]
    rows = [(1, ["a", "zz", "", None, "zz"], T), (2, ["c", "d"], T), (3, ["e", "e2"], T), (4, None, T), (1, ["a", "zz", "", None, "zz"], T), (5, ["a "], T), (6, ["r", "e"], None), (None, ["zz"], T)]
    return {
        "companies": spark.createDataFrame(companies, dim),
        "items": spark.createDataFrame(rows, "k long, ids array<string>, at timestamp").selectExpr("*", "'q' as kind", "1 as depth", "date'2026-01-05' as day"),
    }


REFS = [R.Reference("items", "k", "ids", "companies", "at", "day", True), R.Reference("companies", "id", "parent", "companies")]


def test_direct_and_inherited(spark):
    out = {(r.tbl, r.key, r.ref_id, r.kind, r.depth) for r in R.orphan_cascade(tables(spark), REFS).collect()}
    assert out == {
        ("items", "1", "zz", "direct", 0), ("items", "2", "d", "direct", 0), ("items", "3", "e", "direct", 0), ("items", "5", "a ", "direct", 0),
        ("companies", "b", "gone", "direct", 0), ("companies", "c", "b", "inherited", 1), ("companies", "d", "c", "inherited", 2), ("items", "2", "c", "inherited", 2),
    }


def test_counts_and_empty(spark):
    t = tables(spark)
    n = {(r.tbl, r.field, r.period, r.kind): r.n_refs for r in R.orphan_counts(R.orphan_cascade(t, REFS)).collect()}
    assert n["items", "ids", "2026-01", "direct"] == 4
    empty = {k: v.limit(0) for k, v in t.items()}
    assert R.orphan_cascade(empty, REFS).count() == 0


def test_bound_is_an_error(spark):
    with pytest.raises(RuntimeError):
        R.orphan_cascade(tables(spark), REFS, rounds=1)

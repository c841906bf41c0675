import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.functions import text as X
from tidemark.operators import library
from tidemark.sources import feeds, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first().r


def test_codes_and_status():
    assert (library.exit_code(3, True), library.exit_code(3, False), library.exit_code(0, True)) == (2, 0, 0)
    assert (library.probe_exit_code(2, 2), library.probe_exit_code(1, 2)) == (1, 0)
    got = [library.summary_status(*a) for a in ((False, True, False, 5, 9), (True, False, False, 5, 9), (True, True, True, 5, 9), (True, True, False, 12, 9), (True, True, False, 9, 9))]
    assert got == ["rules_only", "configuration_error", "request_error", "limit_reached", "complete"]


@pytest.mark.parametrize("kind,code,want", [("tier", "daily", "进入日报"), ("tier", "other", "other"), ("health", "quiet", "暂无内容"), ("role", "self", "本公司"), ("region", None, None)])
def test_labels(spark, kind, code, want):
    assert one(spark, code, lambda c: L.label(c, kind)) == want


def test_texts(spark):
    assert [one(spark, v, lambda c: L.rank_text(c.cast("int"))) for v in ("3", "12", "120", "0", None)] == ["03", "12", "120", "--", "--"]
    assert [one(spark, v, L.time_text) for v in ("2026-08-01T09:05:00Z", "soon", None)] == ["08/01 09:05", "soon", None]
    day = F.lit(datetime.date(2026, 8, 29))
    assert [one(spark, v, lambda c: L.date_text(c.try_cast("date"), F.lit("x"), day)) for v in ("2026-08-31", "2026-08-29", "2026-08-01", None)] == ["活动 2026-08-31 · 2 天后", "活动 2026-08-29 · 今天", "活动 2026-08-01 · 28 天前", "发布 x"]
    assert one(spark, "3", lambda c: L.day_mark(day, c.cast("int"))) == "8/26"
    assert one(spark, "Acme Official News", lambda c: L.source_names(F.array(c, F.lit("")), True)) == "Acme 官网新闻"


@pytest.mark.parametrize("title,source,want", [
    ("Acme and Vemax sign deal", "Acme", "Vemax"), ("Vemax & Acme Labs partner on kits", "Acme Labs", "Vemax"), ("Acme announces a wide agreement with Vemax Bio to make kits", "Acme", "Vemax Bio"),
    ("アクメとベマックス、提携", "アクメ", "ベマックス"), ("How Acme and Vemax partner", "Acme", ""), ("Acme opens a site", "Acme", ""), ("Acme teams up with Vemax, Inc", "Acme", "Vemax"),
])
def test_counterparty(spark, title, source, want):
    assert one(spark, title, lambda c: X.counterparty(c, F.lit(source))) == want


def test_methods_of_sources_and_failures(spark):
    cat = spark.createDataFrame([("m2", "a", "active", "big hub feed", "n2", ["s1", "s2", "s2"]), ("m1", "b", "planned", "other", "n1", ["s2"]), ("m3", "b", "active", "none", "", [])], "method_id string, layer string, status string, name string, note string, source_ids array<string>")
    assert {r.source_id: (r.method_id, r.layer) for r in library.of_sources(cat).collect()} == {"s1": ("m2", "a"), "s2": ("m1", "b")}
    h = spark.createDataFrame([("big_hub", "error", "HTTP 500"), ("s1", "quiet", ""), ("lost", "error", "")], "source_id string, status string, error string")
    assert {tuple(r) for r in library.failed(h, cat).collect()} == {("big_hub", "HTTP 500", "n2"), ("lost", "?", "")}
    assert {r.layer: (r.visible, r.total) for r in library.methods(cat, "active").collect()} == {None: (2, 3), "a": (1, 1), "b": (1, 2)}
    assert library.methods(cat.limit(0)).count() == 0 and library.of_sources(cat.limit(0)).count() == 0


def test_collector_knows_ten_types(spark):
    filing = {"cik": "0001", "filings": {"recent": {"form": ["8-K"], "accessionNumber": ["1-2"], "primaryDocument": ["d.htm"], "primaryDocDescription": ["Report"], "filingDate": ["2026-08-01"]}}}
    ids, rec = {"esearchresult": {"idlist": ["7"]}}, {"result": {"uids": ["7"], "7": {"title": "A study", "pubdate": "2026/08/01"}}}
    page = {"base": "https://x.example/", "page": '<a href="/n/1"><h2>A long heading of news</h2></a>'}
    payloads = [("f", json.dumps(filing)), ("p", json.dumps({"ids": json.dumps(ids), "records": json.dumps(rec)})), ("h", json.dumps(page)), ("u", "x")]
    src = spark.createDataFrame([("f", "sec_submissions", True), ("p", "pubmed", True), ("h", "html_links", True), ("u", "telex", True), ("off", "rss", False)], "id string, type string, enabled boolean")
    items, errors = feeds.collect(src, spark.createDataFrame(payloads, "source_id string, payload string"))
    assert {r.source_id for r in items.collect()} == {"f", "p", "h"} and len(feeds.PARSERS) == 10
    assert {tuple(r) for r in errors.collect()} == {("u", "unknown type telex")}
    assert {tuple(r) for r in feeds.raw_counts(src, items).collect()} == {("f", 1), ("p", 1), ("h", 1), ("u", 0)}


def test_page_config_and_export(spark, tmp_path):
    page = sinks.share_page(json.dumps({"x": "</script><b>&"}), "A & B")
    assert "</script><b>" not in page and json.loads(page.split('id="payload">')[1].split("</script>")[0]) == {"x": "</script><b>&"}
    (tmp_path / "c.json").write_text(json.dumps({"companies": [{"id": "a", "n": 1}, {"id": "b", "n": 2}, {"n": 3}]}))
    assert {r.id for r in sinks.read_config(spark, str(tmp_path / "c.json"), "id", "companies").collect()} == {"a", "b"}
    rows = sinks.export_rows(spark.createDataFrame([("1", ["a", "b"], 'say "x"')], "id string, reasons array<string>, title string"))
    assert len(rows.columns) == 23
    sinks.write_csv(rows, str(tmp_path / "out"), mark=True)
    text = next((tmp_path / "out").glob("*.csv")).read_text("utf-8")
    assert text.startswith("﻿\"id\"") or text.startswith('"﻿id"')
    assert '"a; b"' in text and '"say ""x"""' in text
    errs = spark.createDataFrame([("s", "HTTP 500")], "source_id string, error string")
    assert [tuple(r) for r in sinks.error_lines(errs).collect()] == [("errors", 1, "- s: HTTP 500")]

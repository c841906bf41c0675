import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds as S


def df(spark, text, sid="s"):
    return spark.createDataFrame([(sid, text)], "source_id string, payload string")


RSS = """<rss><channel><title>x</title><item><title>A headline that is long enough</title><link>http://x.org/1</link><description>A headline that is long enough - the &lt;b&gt;text&lt;/b&gt;.</description>
<pubDate>Wed, 01 Jul 2026 10:00:00 GMT</pubDate></item><item><title>Home</title><link>http://x.org/2</link></item><item><title>Another headline of some length</title></item></channel></rss>"""


def test_rss_and_broken(spark):
    r = S.rss(df(spark, RSS).unionByName(df(spark, "<rss><channel>", "t")).unionByName(df(spark, None, "u"))).collect()
    assert [(x.source_id, x.title, x.published, x.summary) for x in r] == [("s", "A headline that is long enough", "2026-07-01", "the text .")]


def test_atom(spark):
    text = '<feed><entry><title>T1</title><link href="http://x/1"/><link href="http://x/2"/><published>2026-07-01T10:00:00Z</published></entry></feed>'
    assert [(x.title, x.url, x.published) for x in S.atom(df(spark, text)).collect()] == [("T1", "http://x/1", "2026-07-01")]


def test_sitemap(spark):
    text = "<urlset><url><loc>http://x/products/big-kit_2</loc><lastmod>2026-01-02T00:00</lastmod></url><url><loc>http://x/about</loc></url></urlset>"
    assert [(x.title, x.published) for x in S.sitemap(df(spark, text), ["/products/"]).collect()] == [("big kit 2", "2026-01-02")]


def test_json_feeds(spark):
    filing = {"cik": "0001234", "filings": {"recent": {"form": ["8-K", "4"], "accessionNumber": ["00-11-22", "1"], "primaryDocument": ["a.htm", "b"], "primaryDocDescription": ["Report", ""], "filingDate": ["2026-01-02", ""]}}}
    x = S.filings(df(spark, json.dumps(filing)), ["8-K"]).first()
    assert (x.title, x.url) == ("8-K Report", "https://www.sec.gov/Archives/edgar/data/1234/001122/a.htm")
    recall = {"results": [{"product_description": "Kit", "recall_number": "Z-1", "report_date": "", "event_date_posted": "20260102", "status": "Ongoing"}, {"product_description": "no number"}]}
    x = S.recalls(df(spark, json.dumps(recall))).collect()
    assert [(r.title, r.published) for r in x] == [("Recall Z-1: Kit", "2026-01-02")] and "Z-1%22" in x[0].url
    ids = df(spark, json.dumps({"esearchresult": {"idlist": ["9", "3", "5"]}}))
    rec = df(spark, json.dumps({"result": {"uids": ["3", "9"], "3": {"title": "Three", "pubdate": "2026/01/02"}, "9": {"title": "Nine", "sortpubdate": "2026/02/03 00:00"}}}))
    assert [(r.pos, r.title, r.published) for r in S.research_index(ids, rec).orderBy("pos").collect()] == [(0, "Nine", "2026-02-03"), (1, "Three", "2026-01-02")]
    doi = {"message": {"items": [{"title": ["T"], "DOI": "10.1/x", "published": {"date-parts": [[2026, 3, 4]]}, "author": [{"affiliation": [{"name": "B"}, {"name": "A"}]}, {"affiliation": [{"name": "A"}]}, {}]}]}}
    x = S.doi_records(df(spark, json.dumps(doi))).first()
    assert (x.url, x.published, x.summary) == ("https://doi.org/10.1/x", "2026-03-04", "Affiliations: A; B. Venue: not supplied. DOI: 10.1/x")
    study = {"studies": [{"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "Trial"}, "conditionsModule": {"conditions": list("abcdef")}}}]}
    x = S.studies(df(spark, json.dumps(study))).first()
    assert x.title == "Clinical trial update N1: Trial" and "Conditions: a; b; c; d; e." in x.summary


def test_videos(spark):
    node = lambda i, t, w: {"lockupViewModel": {"contentType": S.VIDEO_TYPE, "contentId": i, "metadata": {"lockupMetadataViewModel": {"title": {"content": t}, "metadata": {"contentMetadataViewModel": {"metadataRows": [{"metadataParts": [{"text": {"content": w}}]}]}}}}}}
    page = "<script>" + S.VIDEO_MARKER + json.dumps({"a": [{"b": node("v1", "A long video title here", "3 weeks ago")}, node("v1", "repeated", ""), node("v2", "Second long video title", "2日前")]}) + ";</script>"
    r = S.videos(df(spark, page), F.to_date(F.lit("2026-08-01"))).orderBy("pos").collect()
    assert [(x.url[-2:], x.published) for x in r] == [("v1", "2026-07-11"), ("v2", "2026-07-30")]


def test_html_links(spark):
    page = '<a href="/a?utm_x=1">text of some length here</a><a href="/a"><h3>The heading of the story</h3><time datetime="2026-01-02"></time></a><a href="/b"><img alt="Image text long enough"></a><a href="/c">Home</a>'
    p = spark.createDataFrame([("s", "http://x.org/news/", page)], "source_id string, base string, payload string")
    r = S.html_links(p).orderBy("pos").collect()
    assert [(x.title, x.url, x.published) for x in r] == [("The heading of the story", "http://x.org/a", "2026-01-02"), ("Image text long enough", "http://x.org/b", "")]


def test_collect_keeps_errors_apart(spark):
    src = spark.createDataFrame([("s", "rss", True), ("t", "rss", True), ("u", "odd", True), ("v", "rss", False)], "id string, type string, enabled boolean")
    items, errors = S.collect(src, df(spark, RSS).unionByName(df(spark, "junk", "t")))
    assert items.count() == 1
    assert {tuple(r) for r in errors.collect()} == {("u", "no payload"), ("u", "unknown type odd"), ("t", "no items")}


def test_fetch_retries():
    waits, calls = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {"Retry-After": "9"} if len(calls) == 2 else {}, None)
        r = io.BytesIO("é".encode())
        r.headers = type("H", (), {"get_content_charset": lambda self: None})()
        return r

    assert S.fetch_text("u", opener=opener, sleep=waits.append) == "é" and waits == [2, 9]
    with pytest.raises(urllib.error.HTTPError):
        S.fetch_text("u", opener=lambda u, timeout: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "no", {}, None)))

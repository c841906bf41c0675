import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.functions import urls as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("url,want", [
    ("HTTPS://Ex.COM/a/?utm_source=x&b=1&gclid=z#top", "https://ex.com/a?b=1"), ("http://x.org/p?a", "http://x.org/p?a="),
    ("http://x.org/?q=a%20b&UTM_x=1", "http://x.org?q=a+b"), ("no address", "no address"), (None, None), ("http://x.org/a//", "http://x.org/a"),
])
def test_normalize_url(spark, url, want):
    assert one(spark, url, U.normalize_url) == want


@pytest.mark.parametrize("f,value,want", [
    (X.title_key, "Big Deal: Foo & Bar - Yahoo Finance", "bigdealfoobar"), (X.title_key, None, ""), (X.is_noise_title, "Read more", True),
    (X.is_noise_title, "2026/07/01", True), (X.is_noise_title, "fourteen chars", True), (X.is_noise_title, "A headline of proper length", False),
    (X.clean_text, "a &amp; <b>b</b>  c", "a & b c"), (X.clean_text, "1 < 2", "1 < 2"), (X.clean_text, None, ""),
    (X.first_sentence, "First one. Second one.", "First one."), (X.document_title, "<title>A long enough page title | Site</title>", "A long enough page title"),
    (X.document_title, "<h1>News</h1><title>Home</title>", ""), (X.strip_company_suffix, "Acme Widgets Co., Ltd.", "acme widgets"),
    (U.slug_title, "https://x.org/a/some-long_slug%20x/?a=1", "some long slug x"),
])
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_long_summary_is_cut_at_a_sentence(spark):
    text = "x" * 150 + ". " + "y" * 200
    assert one(spark, text, lambda c: X.meaningful_summary(c, F.lit(""))) == "x" * 150 + "."
    assert one(spark, "z" * 400, lambda c: X.meaningful_summary(c, F.lit(""))) == "z" * 300 + "..."


def test_full_entities_agree_with_basic(spark):
    for t in ("a &lt; b", "x &amp; y", "plain", "&quot;q&quot;"):
        assert one(spark, t, lambda c: X.clean_text(c, full=True)) == one(spark, t, X.clean_text)
    assert one(spark, "&eacute;", lambda c: X.clean_text(c, full=True)) == "é"


@pytest.mark.parametrize("text,term,want", [("new adc drug", "ADC", True), ("adcetris", "ADC", False), ("抗体医薬", "抗体", True), ("a c++ b", "c++", True)])
def test_term_matches(spark, text, term, want):
    assert one(spark, text, lambda c: X.term_matches(c, F.lit(term))) is want


@pytest.mark.parametrize("title,want", [("prevent infection", "event"), ("demand grows", "regulatory"), ("nothing here", "company")])
def test_categories(spark, title, want):
    assert one(spark, title, lambda c: X.first_substring(c, X.CATEGORIES, "company")) == want


@pytest.mark.parametrize("title,source,want", [
    ("Acme and Bolt Labs partner on kits", "Acme Inc", "Bolt Labs"), ("Acme announces deal with Bolt Labs to sell kits", "Acme", "Bolt Labs"),
    ("How Acme and Bolt partner", "Acme", ""), ("AcmeとBolt、提携", "Acme", "Bolt"),
])
def test_counterparty(spark, title, source, want):
    assert one(spark, title, lambda c: X.counterparty(c, F.lit(source))) == want


@pytest.mark.parametrize("value,want", [("20260701", "2026-07-01"), ("2026/07/01 10:00", "2026-07-01"), ("Wed, 01 Jul 2026 23:30:00 -0200", "2026-07-02"), ("soon", "soon"), ("20269901", "20269901")])
def test_source_date(spark, value, want):
    assert one(spark, value, D.source_date) == want


@pytest.mark.parametrize("value,want", [("3 weeks ago", "2026-07-11"), ("2か月前", "2026-06-02"), ("5 hours ago", "2026-08-01"), ("soon", None)])
def test_relative_date(spark, value, want):
    assert one(spark, value, lambda c: D.relative_date(c, F.to_date(F.lit("2026-08-01"))).cast("string")) == want


@pytest.mark.parametrize("value,want", [("held 2026年7月1日 Tokyo", "2026-07-01"), ("2026-02-30", None)])
def test_calendar_date(spark, value, want):
    assert one(spark, value, lambda c: D.any_calendar_date(c).cast("string")) == want


@pytest.mark.parametrize("day,event,want", [("2026-07-03", False, True), ("2026-07-02", False, False), ("2026-08-02", False, False), (None, False, True), ("2026-07-02", True, True), ("2026-08-31", True, False)])
def test_in_range(spark, day, event, want):
    got = spark.createDataFrame([(day,)], "d string").select(D.in_range(F.to_date("d"), F.to_date(F.lit("2026-08-01")), 30, F.lit(event)).alias("r")).first().r
    assert got is want

"""Landed feed payloads to rows.

Every parser takes payloads (source_id, payload) and gives items (source_id, pos, title, url, published, summary): pos is
the order in the feed. XML and JSON are parsed by built-ins with a fixed schema; only anchors of free HTML and JSON of
unknown depth go through Python. A payload that can't be parsed gives no items; collect() lists it among the errors, so one
bad feed never stops the others. Null payloads are such errors; items without title or address are dropped.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.functions import urls as U

ITEM = "source_id string, pos int, title string, url string, published string, summary string"
COLUMNS = ["source_id", "pos", "title", "url", "published", "summary"]


def _items(df: DataFrame, array: Column) -> DataFrame:
    return df.select("source_id", F.posexplode(array).alias("pos", "x"))


def _ready(df: DataFrame) -> DataFrame:
    d = df.select("source_id", "pos", X.clean_text(F.col("title")).alias("title"), F.trim(F.col("url")).alias("url"), F.coalesce("published", F.lit("")).alias("published"), F.coalesce("summary", F.lit("")).alias("summary"))
    return d.filter((F.col("title") != "") & (F.coalesce("url", F.lit("")) != ""))


def rss(payloads: DataFrame) -> DataFrame:
    """Items of RSS channels; furniture titles are dropped, dates become ISO where they can."""
    schema = "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>"
    x = _items(payloads, F.from_xml("payload", schema)["channel"]["item"])
    d = x.select("source_id", "pos", F.col("x.title").alias("title"), F.col("x.link").alias("url"), D.source_date(F.col("x.pubDate")).alias("published"), X.meaningful_summary(F.col("x.description"), F.col("x.title")).alias("summary"))
    return _ready(d).filter(~X.is_noise_title(F.col("title")))


def atom(payloads: DataFrame) -> DataFrame:
    """Entries of Atom feeds, by their first link; media descriptions cut to 300 characters."""
    schema = "entry array<struct<title:string,link:array<struct<_href:string>>,published:string,summary:string,`media:group`:struct<`media:description`:string>>>"
    x = _items(payloads, F.from_xml("payload", schema)["entry"])
    text = F.coalesce(F.col("x.media:group.media:description"), F.col("x.summary"))
    return _ready(x.select("source_id", "pos", F.col("x.title").alias("title"), F.get(F.col("x.link"), F.lit(0))["_href"].alias("url"), D.source_date(F.col("x.published")).alias("published"), F.left(X.clean_text(text), F.lit(300)).alias("summary")))


def sitemap(payloads: DataFrame, include: list[str] = [], exclude: list[str] = []) -> DataFrame:
    """Addresses of sitemaps with a title from their last segment; as a key for snapshot differences use urls.url_key."""
    x = _items(payloads, F.from_xml("payload", "url array<struct<loc:string,lastmod:string>>")["url"])
    d = x.select("source_id", "pos", U.slug_title(F.col("x.loc")).alias("title"), F.col("x.loc").alias("url"), F.left(F.col("x.lastmod"), F.lit(10)).alias("published"), F.lit("").alias("summary"))
    arr = lambda v: F.array(*[F.lit(t) for t in v]).cast("array<string>")
    return _ready(d.filter(U.has_terms(F.col("url"), arr(include), arr(exclude))))


def filings(payloads: DataFrame, forms: list[str]) -> DataFrame:
    """Regulator filings of the forms, or of all if none is given: parallel arrays zipped by position; the address has the number without dashes and leading zeros cut."""
    schema = "cik string, filings struct<recent:struct<form:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>,filingDate:array<string>>>"
    p = payloads.select("source_id", F.from_json("payload", schema).alias("j"))
    r = F.col("j.filings.recent")
    z = F.arrays_zip(r["form"].alias("form"), r["accessionNumber"].alias("no"), r["primaryDocument"].alias("doc"), r["primaryDocDescription"].alias("what"), r["filingDate"].alias("day"))
    x = p.select("source_id", F.col("j.cik").alias("cik"), F.posexplode(z).alias("pos", "x"))
    x = x.filter(F.col("x.form").isin(*forms)) if forms else x
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace("cik", "^0+", ""), F.lit("/"), F.replace(F.col("x.no"), F.lit("-"), F.lit("")), F.lit("/"), F.col("x.doc"))
    return _ready(x.select("source_id", "pos", F.concat_ws(" ", "x.form", "x.what").alias("title"), url.alias("url"), F.col("x.day").alias("published"), F.lit("").alias("summary")))


def recalls(payloads: DataFrame) -> DataFrame:
    """Recall notices: the first date that is there; notices without product or number are skipped."""
    schema = "results array<struct<recalling_firm:string,product_description:string,recall_number:string,report_date:string,event_date_posted:string,status:string,reason_for_recall:string>>"
    x = _items(payloads, F.from_json("payload", schema)["results"]).filter("coalesce(x.product_description,'') <> '' and coalesce(x.recall_number,'') <> ''")
    day = D.source_date(F.coalesce(F.nullif(F.col("x.report_date"), F.lit("")), F.col("x.event_date_posted")))
    title = F.concat(F.lit("Recall "), F.col("x.recall_number"), F.lit(": "), F.left(X.clean_text(F.col("x.product_description")), F.lit(150)))
    url = F.concat(F.lit("https://api.fda.gov/device/enforcement.json?search="), F.replace(F.url_encode(F.concat(F.lit('recall_number:"'), F.col("x.recall_number"), F.lit('"'))), F.lit("+"), F.lit("%20")))
    text = F.format_string("Recalling firm: %s. Status: %s. Reason: %s", F.coalesce("x.recalling_firm", F.lit("")), F.coalesce("x.status", F.lit("")), X.clean_text(F.col("x.reason_for_recall")))
    return _ready(x.select("source_id", "pos", title.alias("title"), url.alias("url"), day.alias("published"), F.left(text, F.lit(300)).alias("summary")))


def research_index(ids: DataFrame, records: DataFrame) -> DataFrame:
    """A list of ids joined to a second payload of records keyed by id; the list's order is kept, missing records are skipped."""
    i = ids.select("source_id", F.posexplode(F.from_json("payload", "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]).alias("pos", "uid"))
    rec = "struct<title:string,sortpubdate:string,epubdate:string,pubdate:string,fulljournalname:string>"
    # the result holds an array beside the records, so its values are read as text first
    m = records.select("source_id", F.explode(F.from_json("payload", "result map<string,string>")["result"]).alias("uid", "v")).select("source_id", "uid", F.from_json("v", rec[7:-1].replace(":", " ")).alias("x"))
    j = i.join(m, ["source_id", "uid"]).filter("coalesce(x.title,'') <> ''")
    day = F.coalesce(F.nullif(F.col("x.sortpubdate"), F.lit("")), F.nullif(F.col("x.epubdate"), F.lit("")), F.col("x.pubdate"))
    return _ready(j.select("source_id", "pos", F.col("x.title").alias("title"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "uid", F.lit("/")).alias("url"), D.source_date(day).alias("published"), F.concat(F.lit("Journal: "), F.coalesce("x.fulljournalname", F.lit(""))).alias("summary")))


def doi_records(payloads: DataFrame) -> DataFrame:
    """Publication metadata: first title, date parts joined, affiliations flattened, distinct and sorted, text cut to 600."""
    schema = "message struct<items:array<struct<title:array<string>,DOI:string,URL:string,published:struct<`date-parts`:array<array<int>>>,author:array<struct<affiliation:array<struct<name:string>>>>,`container-title`:array<string>>>>"
    x = _items(payloads, F.from_json("payload", schema)["message"]["items"])
    names = F.flatten(F.transform(F.col("x.author"), lambda a: F.transform(F.coalesce(a["affiliation"], F.array().cast("array<struct<name:string>>")), lambda n: F.trim(n["name"]))))
    aff = F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))), "; ")
    parts = F.slice(F.get(F.col("x.published.date-parts"), F.lit(0)), 1, 3)
    text = F.format_string("Affiliations: %s. Venue: %s. DOI: %s", F.coalesce(aff, F.lit("")), F.coalesce(F.get(F.col("x.container-title"), F.lit(0)), F.lit("not supplied")), F.col("x.DOI"))
    d = x.filter("coalesce(x.DOI,'') <> ''").select("source_id", "pos", F.get(F.col("x.title"), F.lit(0)).alias("title"), F.coalesce("x.URL", F.concat(F.lit("https://doi.org/"), "x.DOI")).alias("url"), D.source_date(F.array_join(F.transform(parts, lambda v: v.cast("string")), "-")).alias("published"), F.left(text, F.lit(600)).alias("summary"))
    return _ready(d)


def studies(payloads: DataFrame) -> DataFrame:
    """Clinical studies: nested records, the first five conditions and interventions, text cut to 700."""
    schema = (
        "studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,"
        "sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>,collaborators:array<struct<name:string>>>,"
        "statusModule:struct<overallStatus:string,lastUpdatePostDateStruct:struct<date:string>,studyFirstPostDateStruct:struct<date:string>>,"
        "conditionsModule:struct<conditions:array<string>>,armsInterventionsModule:struct<interventions:array<struct<name:string>>>>>>"
    )
    x = _items(payloads, F.from_json("payload", schema)["studies"]).select("source_id", "pos", F.col("x.protocolSection").alias("p"))
    first5 = lambda c: F.coalesce(F.array_join(F.slice(F.filter(c, lambda v: v.isNotNull() & (v != "")), 1, 5), "; "), F.lit(""))
    name = F.coalesce(F.nullif(F.col("p.identificationModule.briefTitle"), F.lit("")), F.col("p.identificationModule.officialTitle"))
    nct = F.col("p.identificationModule.nctId")
    text = F.format_string(
        "Lead sponsor: %s. Status: %s. Conditions: %s. Interventions: %s.",
        F.coalesce("p.sponsorCollaboratorsModule.leadSponsor.name", F.lit("not supplied")), F.coalesce("p.statusModule.overallStatus", F.lit("")),
        first5(F.col("p.conditionsModule.conditions")), first5(F.col("p.armsInterventionsModule.interventions.name")),
    )
    day = F.coalesce(F.nullif(F.col("p.statusModule.lastUpdatePostDateStruct.date"), F.lit("")), F.col("p.statusModule.studyFirstPostDateStruct.date"))
    d = x.filter(F.coalesce(nct, F.lit("")) != "").select("source_id", "pos", F.concat(F.lit("Clinical trial update "), nct, F.lit(": "), name).alias("title"), F.concat(F.lit("https://clinicaltrials.gov/study/"), nct).alias("url"), D.source_date(day).alias("published"), F.left(text, F.lit(700)).alias("summary"))
    return _ready(d)


# Fixed values of channel pages.
VIDEO_MARKER, VIDEO_NODE, VIDEO_TYPE = "var ytInitialData = ", "lockupViewModel", "LOCKUP_CONTENT_TYPE_VIDEO"


def _nodes(value, key: str) -> Iterator[dict]:
    todo = [value]
    while todo:
        v = todo.pop(0)
        if isinstance(v, dict):
            if isinstance(v.get(key), dict):
                yield v[key]
            todo[:0] = list(v.values())
        elif isinstance(v, list):
            todo[:0] = v


def _dig(v, *path):
    for p in path:
        v = v.get(p) if isinstance(v, dict) else None
    return v


def _videos(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for sid, text in zip(b["source_id"], b["payload"]):
            at = (text or "").find(VIDEO_MARKER)
            if at < 0:
                continue
            try:
                tree, _ = json.JSONDecoder().raw_decode(text[at + len(VIDEO_MARKER) :])
            except ValueError:
                continue
            seen = set()
            for node in _nodes(tree, VIDEO_NODE):
                vid, meta = node.get("contentId"), _dig(node, "metadata", "lockupMetadataViewModel")
                title = _dig(meta, "title", "content")
                if node.get("contentType") != VIDEO_TYPE or not vid or not title or vid in seen:
                    continue
                seen.add(vid)
                rows = _dig(meta, "metadata", "contentMetadataViewModel", "metadataRows") or [{}]
                texts = [t for t in (_dig(p, "text", "content") for p in rows[0].get("metadataParts", [])) if t]
                when = next((t for t in texts if re.search(r"\bago\b", t.lower()) or t.endswith("前")), "")
                out.append((sid, len(seen) - 1, title, f"https://www.youtube.com/watch?v={vid}", when, " · ".join(texts)))
        yield pd.DataFrame(out, columns=COLUMNS).astype({"pos": "int32"})


def videos(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Videos of channel pages: JSON of unknown depth behind a marker; each id once; relative dates counted back from as_of."""
    v = payloads.select("source_id", "payload").mapInPandas(_videos, ITEM)
    d = v.withColumn("published", F.coalesce(D.relative_date(F.col("published"), as_of).cast("string"), F.lit("")))
    return _ready(d).filter(~X.is_noise_title(F.col("title")))


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict] = []
        self.now: dict | None = None
        self.heading = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.now = {"href": a["href"], "attr": a.get("title") or "", "text": "", "heading": "", "alt": "", "time": ""}
            self.found.append(self.now)
        elif self.now is not None:
            if tag in ("h1", "h2", "h3", "h4"):
                self.heading += 1
            elif tag == "img":
                self.now["alt"] = self.now["alt"] or a.get("alt") or ""
            elif tag == "time":
                self.now["time"] = self.now["time"] or a.get("datetime") or ""

    def handle_endtag(self, tag):
        if tag == "a":
            self.now, self.heading = None, 0
        elif tag in ("h1", "h2", "h3", "h4") and self.heading:
            self.heading -= 1

    def handle_data(self, data):
        if self.now is not None:
            self.now["heading" if self.heading else "text"] += data


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for sid, base, page in zip(b["source_id"], b["base"], b["payload"]):
            p = _Anchors()
            p.feed(page or "")
            for k, a in enumerate(p.found):
                ranked = ((4, a["heading"]), (3, a["attr"]), (2, a["alt"]), (1, a["text"] + " " + a["heading"]))
                rank, title = next(((r, " ".join(t.split())) for r, t in ranked if t.strip()), (0, ""))
                try:
                    url = urllib.parse.urljoin(base or "", a["href"])
                except ValueError:
                    continue
                out.append((sid, k, title, url, a["time"], rank))
        yield pd.DataFrame(out, columns=["source_id", "pos", "title", "url", "published", "rank"]).astype({"pos": "int32", "rank": "int32"})


def html_links(pages: DataFrame, include: list[str] = [], exclude: list[str] = []) -> DataFrame:
    """The best anchor per address of (source_id, base, payload): heading before title attribute before image text before text, then the longer title, then the first."""
    d = pages.select("source_id", "base", "payload").mapInPandas(_links, "source_id string, pos int, title string, url string, published string, rank int")
    arr = lambda v: F.array(*[F.lit(t) for t in v]).cast("array<string>")
    d = d.filter(U.has_terms(F.col("url"), arr(include), arr(exclude)) & ~X.is_noise_title(F.col("title"))).withColumn("key", U.normalize_url(F.col("url")))
    best = d.groupBy("source_id", "key").agg(
        F.min_by(F.struct("pos", "title", "url"), F.struct(-F.col("rank"), -F.length("title"), "pos")).alias("x"),
        F.min_by(F.when(F.col("published") != "", F.col("published")), F.when(F.col("published") != "", F.col("pos"))).alias("published"),
    )
    return _ready(best.select("source_id", "x.pos", "x.title", "x.url", D.source_date(F.coalesce("published", F.lit(""))).alias("published"), F.lit("").alias("summary")))


def all_filings(payloads: DataFrame) -> DataFrame:
    """filings() of every form."""
    return filings(payloads, [])


def channel_videos(payloads: DataFrame) -> DataFrame:
    """videos() as of the day of the run."""
    return videos(payloads, F.current_date())


def research_pairs(payloads: DataFrame) -> DataFrame:
    """research_index() of payloads that hold both steps: {"ids": first answer, "records": second answer}."""
    j = payloads.select("source_id", F.from_json("payload", "ids string, records string").alias("j"))
    return research_index(j.select("source_id", F.col("j.ids").alias("payload")), j.select("source_id", F.col("j.records").alias("payload")))


def page_links(payloads: DataFrame) -> DataFrame:
    """html_links() of payloads that hold a page and its address: {"base": address, "page": text}."""
    j = payloads.select("source_id", F.from_json("payload", "base string, page string").alias("j"))
    return html_links(j.select("source_id", "j.base", F.col("j.page").alias("payload")))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rss": rss, "atom": atom, "sitemap_urls": sitemap, "openfda": recalls, "crossref": doi_records, "clinical_trials": studies,
    "youtube_channel": channel_videos, "sec_submissions": all_filings, "pubmed": research_pairs, "html_links": page_links,
}


def collect(sources: DataFrame, payloads: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]] = PARSERS) -> tuple[DataFrame, DataFrame]:
    """(items, errors): payloads of enabled sources parsed by type. errors: source_id, error - unknown types, missing payloads, none parsed."""
    src = sources.filter(F.coalesce("enabled", F.lit(True))).select(F.col("id").alias("source_id"), "type").dropDuplicates(["source_id"])
    p = payloads.join(src, "source_id")
    items = None
    for kind, parse in parsers.items():
        part = parse(p.filter(F.col("type") == kind).select("source_id", "payload"))
        items = part if items is None else items.unionByName(part)
    none = src.join(payloads.filter("payload is not null").select("source_id"), "source_id", "left_anti").select("source_id", F.lit("no payload").alias("error"))
    unknown = src.filter(~F.col("type").isin(*parsers)).select("source_id", F.concat(F.lit("unknown type "), "type").alias("error"))
    empty = p.filter(F.col("type").isin(*parsers) & F.col("payload").isNotNull()).select("source_id").distinct().join(items.select("source_id"), "source_id", "left_anti").select("source_id", F.lit("no items").alias("error"))
    return items, none.unionByName(unknown).unionByName(empty)


def raw_counts(sources: DataFrame, items: DataFrame) -> DataFrame:
    """(source_id, raw): items of each enabled source before any gate, none included."""
    src = sources.filter(F.coalesce("enabled", F.lit(True))).select(F.col("id").alias("source_id")).distinct()
    return src.join(items.groupBy("source_id").agg(F.count(F.lit(1)).alias("raw")), "source_id", "left").na.fill(0, ["raw"])


def numbered(items: DataFrame) -> DataFrame:
    """items with seq, their order within the source."""
    return items.withColumn("seq", F.row_number().over(Window.partitionBy("source_id").orderBy("pos")))


RETRY_CODES = (429, 500, 502, 503, 504)


def fetch_text(url: str, attempts: int = 3, timeout: float = 20, extra_codes: tuple[int, ...] = (), opener=urllib.request.urlopen, sleep=time.sleep) -> str:
    """A page's text: some server errors are tried again, after what the server asks or attempt + 2 seconds; bytes that don't decode are replaced."""
    for attempt in range(attempts):
        try:
            with opener(url, timeout=timeout) as r:
                return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in (*RETRY_CODES, *extra_codes) or attempt == attempts - 1:
                raise
            asked = e.headers.get("Retry-After", "") if e.headers else ""
            sleep(max(float(asked) if str(asked).isdigit() else 0, attempt + 2))
    raise AssertionError

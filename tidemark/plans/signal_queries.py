"""Queries on signals: the candidates table as the engine's fact rows. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import dedupe, gates, graph, marts, rules, state, terms
from tidemark.session import read_table, small_side

AS_OF = "2026-08-29"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def today():
    return F.to_date(F.lit(AS_OF))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates as signals, one row per candidate_id."""
    c = read_table(spark, sf, "candidates").dropDuplicates(["candidate_id"])
    return c.select(
        F.col("candidate_id").alias("seq"), "company_id", "source_id", "source_label", F.coalesce("source_trust", F.lit("unknown")).alias("trust"),
        "title", "url", F.coalesce("summary", F.lit("")).alias("summary"), "score", "tier", "category", F.coalesce("category_hint", F.lit("")).alias("category_hint"),
        "signal_type", "source_ids", "source_labels", "matched_company_ids", "intelligence", "business_event_type",
        F.col("acro_relevance.level").alias("relevance"), F.col("recommended_action.type").alias("action"), "run_date", "published",
        D.calendar_date(F.col("published")).alias("pub"),
    )


S = """WITH s AS (SELECT candidate_id AS seq, company_id, source_id, source_label, coalesce(source_trust,'unknown') AS trust, title, url,
 coalesce(summary,'') AS summary, score, tier, category, coalesce(category_hint,'') AS category_hint, signal_type, source_ids, source_labels,
 matched_company_ids, intelligence, business_event_type, acro_relevance.level AS relevance, recommended_action.type AS action, run_date, published,
 try_cast(nullif(regexp_extract(trim(published),'^20[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}'),'') AS DATE) AS pub
 FROM candidates QUALIFY row_number() OVER (PARTITION BY candidate_id)=1)
"""
DAY = f"DATE '{AS_OF}'"
_P = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
_Q = f"""array_to_string(list_transform(list_filter(string_split(regexp_extract(url,{_P},4),'&'), lambda p: p<>'' AND NOT regexp_matches(lower(p),'^(utm_|srsltid|fbclid|gclid)')),
 lambda p: url_encode(url_decode(split_part(p,'=',1)))||'='||url_encode(url_decode(CASE WHEN contains(p,'=') THEN regexp_replace(p,'^[^=]*=','') ELSE '' END))),'&')"""
NORM = f"""(CASE WHEN regexp_matches(url,{_P}) THEN lower(regexp_extract(url,{_P},1))||'://'||lower(regexp_extract(url,{_P},2))||regexp_replace(regexp_extract(url,{_P},3),'/+$','')
 ||CASE WHEN {_Q}<>'' THEN '?'||{_Q} ELSE '' END ELSE url END)"""


def clean_sql(x: str) -> str:
    e = f"coalesce({x},'')"
    for k, v in X.ENTITIES.items():
        e = f"replace({e},'{k}','{v.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace(CASE WHEN contains({e},'<') AND contains({e},'>') THEN regexp_replace({e},'<[^>]*>',' ','g') ELSE {e} END,'\\s+',' ','g'))"


def title_key_sql(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({clean_sql(x)},'\\s+-\\s+[^-]{{2,80}}$',''),'[^\\p{{L}}\\p{{N}}_]+','','g'))"


# ---- addresses and text


@query(S + f"SELECT seq, {NORM} AS norm_url, left(sha256({NORM}),16) AS url_key FROM s")
def url_normalize(spark, sf):
    s = signals(spark, sf)
    return s.select("seq", U.normalize_url(F.col("url")).alias("norm_url"), U.url_key(F.col("url")).alias("url_key"))


@query(S + f"SELECT lower(regexp_extract(url,{_P},2)) AS host, count(*) AS n FROM s GROUP BY 1")
def url_host_mix(spark, sf):
    return marts.mix(signals(spark, sf).withColumn("h", U.host(F.col("url"))), "h", "host")


@query(S + r"SELECT seq, trim(regexp_replace(url_decode(regexp_extract(regexp_replace(regexp_replace(url,'[?#].*$',''),'/+$',''),'([^/]*)$',1)),'[-_]+',' ','g')) AS slug FROM s")
def url_slug_title(spark, sf):
    return signals(spark, sf).select("seq", U.slug_title(F.col("url")).alias("slug"))


def _pages(spark, sf):
    s = signals(spark, sf)
    page = F.concat(
        F.lit("<html><head><title>"), "title", F.lit(" | "), "source_label", F.lit("</title></head><body>"),
        F.when(F.col("seq") % 3 != 0, F.concat(F.lit('<H1 class="x">'), "title", F.lit("</H1>"))).otherwise(""),
        F.lit('<a href="'), "url", F.lit('">'), "title", F.lit('</a><a href="/about?x=1">About us</a></body></html>'),
    )
    return s.select("seq", "title", "url", "source_id", page.alias("page"))


PAGES = S + """, p AS (SELECT seq, title, url, source_id, '<html><head><title>'||title||' | '||source_label||'</title></head><body>'||CASE WHEN seq%3<>0 THEN '<H1 class="x">'||title||'</H1>' ELSE '' END
 ||'<a href="'||url||'">'||title||'</a><a href="/about?x=1">About us</a></body></html>' AS page FROM s)
"""
_NOISE = ",".join(f"'{t}'" for t in X.NOISE_TITLES)


def noise_sql(x: str) -> str:
    t = f"lower(trim({x}))"
    return f"({t} IN ({_NOISE}) OR length({t})<15 OR regexp_full_match({t},'20[0-9]{{2}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}(\\s*\\([^)]{{1,3}}\\))?') OR regexp_matches({t},'^(share on|follow us on|cookie|accept cookies)'))"


_H1 = clean_sql(r"regexp_extract(page,'(?is)<h1\b[^>]*>(.*?)</h1>',1)")
_TT = "trim(regexp_replace(" + clean_sql(r"regexp_extract(page,'(?is)<title\b[^>]*>(.*?)</title>',1)") + r",'(?s)\s+[|｜]\s+.*$',''))"


@query(PAGES + f"SELECT seq, CASE WHEN {_H1}<>'' AND NOT {noise_sql(_H1)} THEN {_H1} WHEN {_TT}<>'' AND NOT {noise_sql(_TT)} THEN {_TT} ELSE '' END AS title FROM p")
def html_title_extract(spark, sf):
    return _pages(spark, sf).select("seq", X.document_title(F.col("page")).alias("title"))


@query(PAGES + """, l AS (SELECT seq, unnest(regexp_extract_all(page,'<a href="([^"]*)"',1)) AS href FROM p) SELECT seq, href FROM l WHERE NOT contains(href,'/about')""")
def html_link_explode(spark, sf):
    p = _pages(spark, sf).select("seq", F.explode(F.regexp_extract_all("page", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.filter(~F.col("href").contains("/about"))


@query(PAGES + f", b AS (SELECT *, {NORM} AS nu FROM p) SELECT nu AS norm_url, seq, title FROM b WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY nu ORDER BY length(title) DESC, seq)=1")
def html_best_link(spark, sf):
    p = _pages(spark, sf).select(U.normalize_url(F.col("url")).alias("norm_url"), "seq", "title").filter("norm_url is not null")
    return dedupe.best_per_key(p, ["norm_url"], [-F.length("title"), "seq"])


@query(PAGES + f"SELECT seq, length({clean_sql('page')}) AS n, {clean_sql('page')} AS text FROM p")
def text_clean_html(spark, sf):
    t = X.clean_text(F.col("page"))
    return _pages(spark, sf).select("seq", F.length(t).cast("long").alias("n"), t.alias("text"))


@query(S + f"SELECT seq, title FROM s WHERE {noise_sql('title')}")
def noise_title_filter(spark, sf):
    return signals(spark, sf).filter(X.is_noise_title(F.col("title"))).select("seq", "title")


_SK = f"regexp_replace(lower({clean_sql('summary')}),'[^\\p{{L}}\\p{{N}}_]+','','g')"
_TK = "regexp_replace(lower(" + clean_sql("regexp_replace(coalesce(title,''),'\\s+-\\s+[^-]{2,80}$','')") + "),'[^\\p{L}\\p{N}_]+','','g')"
_LOW = f"({_SK}='' OR {_SK}={_TK} OR ({_TK}<>'' AND (starts_with({_SK},{_TK}) OR starts_with({_TK},{_SK}))) OR length({_SK})<28)"


@query(S + f"SELECT seq, {_LOW} AS low FROM s")
def low_info_summary(spark, sf):
    return signals(spark, sf).select("seq", X.is_low_information(F.col("summary"), F.col("title")).alias("low"))


@query(S + f"SELECT seq, {title_key_sql('title')} AS k FROM s")
def title_key(spark, sf):
    return signals(spark, sf).select("seq", X.title_key(F.col("title")).alias("k"))


_T = "trim(regexp_replace(" + clean_sql("text") + r",'^[\s\-|.]+',''))"
_L3 = f"left({_T},300)"


def _last(x: str) -> str:
    return f"(CASE WHEN contains({_L3},'{x}') THEN 302-instr(reverse({_L3}),'{x[::-1]}')-{len(x)} ELSE 0 END)"


_END = f"greatest({_last('。')},{_last('. ')},{_last('！')})"


@query(f"SELECT doc_id, CASE WHEN length({_T})<=300 THEN {_T} WHEN {_END}>101 THEN left({_T},{_END}) ELSE {_L3}||'...' END AS cut FROM documents")
def summary_truncate(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.meaningful_summary(F.col("text"), F.lit("")).alias("cut"))


_F = "trim(regexp_replace(" + clean_sql("text") + r",'\s+-\s+[^-]{2,80}$',''))"
_F1 = f"trim(regexp_replace({_F},'(?s)^(.*?[。.!！？])\\s+.*$','\\1'))"


@query(f"SELECT doc_id, CASE WHEN length({_F1})>120 THEN regexp_replace(left({_F1},120),'[，,、；;:： ]+$','')||'...' ELSE {_F1} END AS first FROM documents")
def first_sentence(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("first"))


@query(S + """SELECT seq, left(array_to_string(list_distinct_first[1:3],', '),120) AS labels FROM (SELECT seq,
 list_transform(list_filter(list_zip(l, range(1,len(l)+1)), lambda x: x[1]<>'' AND list_position(l,x[1])=x[2]), lambda x: x[1]) AS list_distinct_first
 FROM (SELECT seq, list_filter(list_concat(intelligence.targets,intelligence.modalities,intelligence.product_needs), lambda y: y IS NOT NULL) AS l FROM s))""")
def label_join(spark, sf):
    i = F.col("intelligence")
    return signals(spark, sf).select("seq", X.join_labels(F.concat(i["targets"], i["modalities"], i["product_needs"])).alias("labels"))


def _case(x: str, cats) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x},'{t}')" for t in ts) + f" THEN '{c}'" for c, ts in cats) + " ELSE 'company' END"


@query(S + f"SELECT seq, CASE WHEN category_hint<>'' THEN category_hint ELSE {_case('lower(title)', X.CATEGORIES)} END AS category FROM s")
def category_cascade(spark, sf):
    c = X.first_substring(F.lower("title"), X.CATEGORIES, "company")
    return signals(spark, sf).select("seq", F.when(F.col("category_hint") != "", F.col("category_hint")).otherwise(c).alias("category"))


_B = "(?<![A-Za-z0-9_])"


def _re2(p: str) -> str:
    return p.replace("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])").replace("(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])")


_REG = "CASE " + " ".join(f"WHEN regexp_matches(lower(title||' '||summary||' '||source_label),'{_re2(p)}') THEN '{r}'" for r, p in X.REGIONS) + " ELSE 'global' END"


def _region():
    return X.first_match(F.lower(F.concat_ws(" ", "title", "summary", "source_label")), X.REGIONS, "global")


@query(S + f"SELECT seq, {_REG} AS region FROM s")
def region_infer(spark, sf):
    return signals(spark, sf).select("seq", _region().alias("region"))


_REGS = [r for r, _ in X.REGIONS] + ["global"]


@query(S + f", r AS (SELECT {_REG} AS k, count(*) AS n FROM s GROUP BY 1) SELECT d.k, coalesce(n,0) AS n FROM (VALUES {','.join(f'({chr(39)}{r}{chr(39)})' for r in _REGS)}) d(k) LEFT JOIN r USING (k)")
def region_distribution(spark, sf):
    return marts.filled(marts.mix(signals(spark, sf).withColumn("r", _region()), "r"), _REGS)


@query("""SELECT id AS source_id, CASE WHEN regexp_matches(lower(id),'google_news|bing_news|news_search|aggregat') THEN 'aggregator'
 WHEN regexp_matches(lower(id),'crossref|pubmed|clinical|pmda|amed|openfda|patent|research|trial|regulat') THEN 'research_regulatory' WHEN regexp_matches(lower(id),'youtube|multimedia|video|linkedin|wechat|twitter|social') THEN 'social_content'
 WHEN regexp_matches(lower(id),'linkj|ispark|kinki|firm_|conference|exhibition|channel_event') THEN 'market_channel'
 WHEN regexp_matches(lower(id),'businesswire|prnewswire|globenewswire|prtimes|nikkei|pharmcube|fierce|biospace|gen_|selectscience|bioprocess|newswire|media') THEN 'wire_media'
 WHEN NOT contains(lower(id),'official_') AND regexp_matches(lower(id||' '||label||' '||type),'social|media|video') THEN 'social_content' ELSE 'official' END AS layer FROM sources""")
def source_layers(spark, sf):
    return read_table(spark, sf, "sources").select(F.col("id").alias("source_id"), X.source_layer(F.col("id"), F.col("label"), F.col("type")).alias("layer"))


_ESC = "replace(replace(replace(replace(replace(title,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),chr(39),'&#39;')"


@query(S + f"SELECT seq, {_ESC} AS safe FROM s")
def html_escape(spark, sf):
    return signals(spark, sf).select("seq", X.escape_html(F.col("title")).alias("safe"))


# ---- dates


@query(S + r"SELECT seq, CAST(pub AS VARCHAR) AS leading, CAST(try_cast(nullif(regexp_extract(published,'(20[0-9]{2})[./年-]([0-9]{1,2})[./月-]([0-9]{1,2})',1),'')||'-'||lpad(regexp_extract(published,'(20[0-9]{2})[./年-]([0-9]{1,2})[./月-]([0-9]{1,2})',2),2,'0')||'-'||lpad(regexp_extract(published,'(20[0-9]{2})[./年-]([0-9]{1,2})[./月-]([0-9]{1,2})',3),2,'0') AS DATE) AS VARCHAR) AS anywhere FROM s")
def date_normalize(spark, sf):
    return signals(spark, sf).select("seq", F.col("pub").cast("string").alias("leading"), D.any_calendar_date(F.col("published")).cast("string").alias("anywhere"))


_RE = r"'([0-9]+)\s+(second|minute|hour|day|week|month|year)s?\s+ago'"
_RJ = "'([0-9]+)\\s*(秒|分|時間|日|週間|か月|ヶ月|月|年)前'"
_UD = "CASE u " + " ".join(f"WHEN '{u}' THEN {d}" for u, d in D.UNIT_DAYS.items()) + " ELSE 0 END"


@query(S + f""", r AS (SELECT seq, CASE WHEN regexp_matches(lower(published),{_RE}) THEN regexp_extract(lower(published),{_RE},1) ELSE regexp_extract(published,{_RJ},1) END AS n,
 CASE WHEN regexp_matches(lower(published),{_RE}) THEN regexp_extract(lower(published),{_RE},2) ELSE regexp_extract(published,{_RJ},2) END AS u FROM s)
 SELECT seq, CAST({DAY} - CAST(n AS INTEGER)*({_UD}) AS VARCHAR) AS day FROM r WHERE n<>''""")
def relative_date(spark, sf):
    s = signals(spark, sf).select("seq", D.relative_date(F.col("published"), today()).cast("string").alias("day"))
    return s.filter("day is not null")


@query(S + f"SELECT CASE WHEN pub IS NULL THEN 'none' WHEN {DAY}-pub<0 THEN 'future' WHEN {DAY}-pub<=30 THEN '0-30' WHEN {DAY}-pub<=90 THEN '31-90' WHEN {DAY}-pub<=180 THEN '91-180' ELSE 'older' END AS bucket, count(*) AS n FROM s GROUP BY 1")
def age_bucket(spark, sf):
    a = D.age_days(F.col("pub"), today())
    b = F.when(F.col("pub").isNull(), "none").when(a < 0, "future").when(a <= 30, "0-30").when(a <= 90, "31-90").when(a <= 180, "91-180").otherwise("older")
    return marts.mix(signals(spark, sf).withColumn("b", b), "b", "bucket")


def range_sql(days: int) -> str:
    return f"coalesce(CASE WHEN signal_type='event' THEN pub-{DAY}>=-{days} AND pub-{DAY}<{days} ELSE {DAY}-pub>=0 AND {DAY}-pub<{days} END,true)"


@query(S + f"SELECT seq FROM s WHERE {range_sql(30)}")
def range_filter(spark, sf):
    return signals(spark, sf).filter(D.in_range(F.col("pub"), today(), 30, F.col("signal_type") == "event")).select("seq")


# ---- gates, de-duplication


_GATE = f"""SELECT s.* FROM s JOIN sources d ON d.id=s.source_id WHERE coalesce(d.enabled,true)
 AND (len(coalesce(d.include_url_terms,[]))=0 OR len(list_filter(d.include_url_terms, lambda t: contains(lower(s.url),lower(t))))>0)
 AND len(list_filter(coalesce(d.exclude_title_terms,[]), lambda t: contains(lower(s.title),lower(t))))=0
 AND (NOT coalesce(d.require_published,false) OR s.pub IS NOT NULL) AND (d.max_age_days IS NULL OR s.pub IS NULL OR {DAY}-s.pub<=d.max_age_days)"""


@query(S + f", g AS ({_GATE}) SELECT seq, source_id FROM (SELECT g.seq, g.source_id, d.max_items, row_number() OVER (PARTITION BY g.source_id ORDER BY g.seq) AS n FROM g LEFT JOIN sources d ON d.id=g.source_id) WHERE max_items IS NULL OR n<=max_items")
def source_gate(spark, sf):
    src = read_table(spark, sf, "sources")
    passed = gates.source_gate(signals(spark, sf), src, today())
    return gates.limit_per_source(passed, src, "seq").select("seq", "source_id")


@query(S + f"SELECT min(seq) AS leader, count(*) AS n FROM (SELECT seq, {NORM} AS u FROM s) WHERE u IS NOT NULL GROUP BY u")
def dedupe_url(spark, sf):
    s = signals(spark, sf).select("seq", U.normalize_url(F.col("url")).alias("u")).filter("u is not null")
    return s.groupBy("u").agg(F.min("seq").alias("leader"), F.count(F.lit(1)).alias("n")).drop("u")


@query(S + f"SELECT min(seq) AS leader, count(*) AS n FROM (SELECT seq, {title_key_sql('title')} AS t FROM s) WHERE length(t)>=30 GROUP BY t")
def dedupe_title(spark, sf):
    s = signals(spark, sf).select("seq", X.title_key(F.col("title")).alias("t")).filter(F.length("t") >= 30)
    return s.groupBy("t").agg(F.min("seq").alias("leader"), F.count(F.lit(1)).alias("n")).drop("t")


@query()
def dedupe_greedy(spark, sf):
    return dedupe.leaders(signals(spark, sf))


@query()
def merge_duplicates(spark, sf):
    s = signals(spark, sf)
    m = dedupe.merged(s, dedupe.leaders(s))
    return m.select("leader", "n_rows", F.array_join("source_ids", "|").alias("source_ids"), F.array_join("company_ids", "|").alias("company_ids"), "summary", "published")


# ---- terms


def _alias_dim(spark, sf):
    c = read_table(spark, sf, "companies")
    return c.select(F.col("id").alias("company_id"), F.explode(F.array_distinct("aliases")).alias("term")).filter("trim(term) <> ''")


_HIT = """regexp_matches(lower(coalesce(s.title,'')||' '||s.summary), CASE WHEN regexp_matches(t.term,'^[a-z0-9][a-z0-9 .+/-]*$')
 THEN '(^|[^a-z0-9])'||regexp_escape(t.term)||'($|[^a-z0-9])' ELSE regexp_escape(t.term) END) AND contains(lower(coalesce(s.title,'')||' '||s.summary),t.term)"""
_ALIAS = "a AS (SELECT DISTINCT id AS company_id, lower(x) AS term FROM (SELECT id, unnest(aliases) AS x FROM companies) WHERE trim(x)<>'')"


@query(S + f", {_ALIAS} SELECT DISTINCT s.seq, t.company_id FROM s JOIN a t ON {_HIT}")
def company_match(spark, sf):
    s = signals(spark, sf)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "summary")
    return terms.term_hits(s, "seq", text, _alias_dim(spark, sf)).select("seq", "company_id").distinct()


@query(S + f", {_ALIAS}, h AS (SELECT DISTINCT s.seq, t.company_id FROM s JOIN a t ON {_HIT}) SELECT s.seq, CASE WHEN coalesce(s.company_id,'')<>'' THEN s.company_id ELSE min(h.company_id) END AS company_id FROM s LEFT JOIN h USING (seq) GROUP BY s.seq, s.company_id")
def company_match_first(spark, sf):
    s = signals(spark, sf)
    m = company_match(spark, sf).groupBy("seq").agg(F.min("company_id").alias("_m"))
    return s.join(m, "seq", "left").select("seq", F.when(F.coalesce("company_id", F.lit("")) != "", F.col("company_id")).otherwise(F.col("_m")).alias("company_id"))


def _topic_dim(spark, sf):
    c = read_table(spark, sf, "companies")
    return c.select(F.explode("strategic_topics").alias("term")).filter("term is not null").distinct()


@query(S + f", t AS (SELECT DISTINCT lower(x) AS term, x AS label FROM (SELECT unnest(strategic_topics) AS x FROM companies) WHERE x IS NOT NULL) SELECT t.label, count(DISTINCT s.seq) AS n FROM s JOIN t ON {_HIT} GROUP BY 1")
def ontology_hits(spark, sf):
    dim = _topic_dim(spark, sf).select(F.col("term").alias("label"), "term")
    h = terms.term_hits(signals(spark, sf), "seq", F.concat_ws(" ", F.coalesce("title", F.lit("")), "summary"), dim)
    return h.groupBy("label").agg(F.countDistinct("seq").alias("n"))


@query(S + f", t AS (SELECT DISTINCT lower(x) AS term, x AS label FROM (SELECT unnest(strategic_topics) AS x FROM companies) WHERE x IS NOT NULL) SELECT s.seq, string_agg(DISTINCT t.label,'|' ORDER BY t.label) AS labels FROM s JOIN t ON {_HIT} GROUP BY 1")
def ontology_arrays(spark, sf):
    dim = _topic_dim(spark, sf).select(F.col("term").alias("label"), "term")
    h = terms.term_hits(signals(spark, sf), "seq", F.concat_ws(" ", F.coalesce("title", F.lit("")), "summary"), dim)
    return terms.ordered_labels(h, ["seq"], "label", "label").select("seq", F.array_join("labels", "|").alias("labels"))


_GROUPS = ("targets", "modalities", "product_needs", "development_stages", "business_actions", "event_signals")


@query(S + " UNION ALL ".join((", " if i == 0 else "") + ("x AS (" if i == 0 else "") + f"SELECT '{g}' AS grp, unnest(intelligence.{g}) AS label, seq FROM s" for i, g in enumerate(_GROUPS)) + ") SELECT grp, count(*) AS n_labels, count(DISTINCT seq) AS n_items, count(DISTINCT label) AS n_distinct FROM x GROUP BY 1")
def ontology_coverage(spark, sf):
    i = F.col("intelligence")
    e = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), i[g].alias("labels")) for g in _GROUPS]))
    x = signals(spark, sf).select("seq", e.alias("x")).select("seq", "x.grp", F.explode("x.labels").alias("label"))
    return x.groupBy("grp").agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("seq").alias("n_items"), F.countDistinct("label").alias("n_distinct"))


@query(S + """, e AS (SELECT seq, unnest(list_distinct(matched_company_ids)) AS id FROM s), t AS (SELECT DISTINCT e.seq, unnest(c.strategic_topics) AS topic FROM e JOIN (SELECT DISTINCT id, strategic_topics FROM companies) c USING (id))
 SELECT seq, count(DISTINCT topic) AS n_topics, string_agg(DISTINCT topic,'|' ORDER BY topic) AS topics FROM t GROUP BY 1""")
def profile_merge(spark, sf):
    c = read_table(spark, sf, "companies").select(F.col("id"), "strategic_topics").dropDuplicates(["id"])
    e = signals(spark, sf).select("seq", F.explode(F.array_distinct("matched_company_ids")).alias("id"))
    t = e.join(small_side(c), "id").select("seq", F.explode("strategic_topics").alias("topic"))
    g = t.groupBy("seq").agg(F.array_sort(F.collect_set("topic")).alias("x"))
    return g.filter(F.size("x") > 0).select("seq", F.size("x").cast("long").alias("n_topics"), F.array_join("x", "|").alias("topics"))


_TERMS = ["trial", "recall", "launch", "kit", "site", "data"]


@query(S + ", b AS (SELECT seq, trust, lower(coalesce(title,'')||' '||summary||' '||coalesce(url,'')) AS t FROM s), c AS (SELECT seq, trust, " + "+".join(f"CASE WHEN contains(t,'{x}') THEN 1 ELSE 0 END" for x in _TERMS) + " AS hits FROM b) SELECT seq, CAST(hits AS BIGINT) AS hits, CAST(CASE WHEN trust='regulator' THEN 20 WHEN trust='owned' THEN 15 ELSE 0 END+least(30,6*hits) AS BIGINT) AS points FROM c")
def score_components(spark, sf):
    blob = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "summary", F.coalesce("url", F.lit(""))))
    hits = terms.term_counts(blob, _TERMS)
    points, _ = rules.additive([
        (F.col("trust") == "regulator", 20, "regulator"), (F.col("trust") == "owned", 15, "owned"), (hits > 0, F.least(F.lit(30), 6 * hits), "terms"),
    ])
    return signals(spark, sf).select("seq", hits.cast("long").alias("hits"), points.cast("long").alias("points"))


# ---- mixes and marts


@query(S + "SELECT category AS k, count(*) AS n FROM s GROUP BY 1")
def mix_category(spark, sf):
    return marts.mix(signals(spark, sf), "category")


@query(S + "SELECT k, count(*) AS n FROM (SELECT unnest(list_distinct(source_labels)) AS k FROM s) GROUP BY 1")
def mix_source(spark, sf):
    return marts.multi_mix(signals(spark, sf), "source_labels")


@query(S + "SELECT signal_type AS k, count(*) AS n FROM s GROUP BY 1")
def mix_signal_type(spark, sf):
    return marts.mix(signals(spark, sf), "signal_type")


@query("SELECT source, lang, count(*) AS n, CAST(sum(coalesce(n_chars,0)) AS BIGINT) AS chars FROM documents GROUP BY 1,2")
def language_source_mix(spark, sf):
    return read_table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


@query(S + "SELECT count(*) AS items, count(*) FILTER (tier='immediate') AS immediate, count(*) FILTER (tier='daily') AS daily, count(*) FILTER (tier='archive') AS archive, count(DISTINCT source_id) AS sources, (SELECT count(DISTINCT c) FROM (SELECT unnest(matched_company_ids) AS c FROM s) WHERE c<>'') AS companies FROM s")
def run_summary(spark, sf):
    s = signals(spark, sf)
    a = s.agg(F.count(F.lit(1)).alias("items"), *marts.tier_counts(), F.countDistinct("source_id").alias("sources"))
    b = s.select(F.explode("matched_company_ids").alias("c")).filter("c <> ''").agg(F.countDistinct("c").alias("companies"))
    return a.join(F.broadcast(b))


@query(S + "SELECT tier, count(*) AS n, CAST(sum(score) AS BIGINT) AS points FROM s GROUP BY 1")
def tier_counts(spark, sf):
    return signals(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("points"))


_HEALTH = """, e AS (SELECT seq, tier, pub, unnest(list_distinct(source_ids)) AS source_id FROM s), g AS (SELECT source_id, count(*) AS total, count(*) FILTER (tier='immediate') AS immediate,
 count(*) FILTER (tier='daily') AS daily, count(*) FILTER (tier='archive') AS archive, max(pub) AS last_published FROM e GROUP BY 1),
 h AS (SELECT src.id AS source_id, src.label AS source_label, coalesce(src.enabled,true) AS enabled, coalesce(total,0) AS total, coalesce(immediate,0) AS immediate, coalesce(daily,0) AS daily, coalesce(archive,0) AS archive,
 last_published, coalesce(immediate,0)+coalesce(daily,0) AS selected FROM sources src LEFT JOIN g ON g.source_id=src.id),
 hh AS (SELECT *, CASE WHEN total=0 THEN 0 ELSE CAST(round_even((CAST(selected AS DOUBLE)/total)*100,0) AS BIGINT) END AS selected_rate,
 CASE WHEN NOT enabled THEN 'pending' WHEN selected>0 THEN 'productive' WHEN total>0 THEN 'archive_only' ELSE 'quiet' END AS status FROM h)"""


@query(S + _HEALTH + " SELECT * FROM hh")
def source_health(spark, sf):
    return marts.source_health(read_table(spark, sf, "sources"), signals(spark, sf))


@query(S + _HEALTH + " SELECT status, count(*) AS n, CAST(sum(total) AS BIGINT) AS items, CAST(sum(selected) AS BIGINT) AS selected FROM hh GROUP BY 1")
def health_metrics(spark, sf):
    h = marts.source_health(read_table(spark, sf, "sources"), signals(spark, sf))
    return h.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("items"), F.sum("selected").alias("selected"))


@query(S + _HEALTH + " SELECT source_id, row_number() OVER (ORDER BY CASE status WHEN 'error' THEN 0 WHEN 'pending' THEN 1 WHEN 'quiet' THEN 2 WHEN 'archive_only' THEN 3 WHEN 'productive' THEN 4 ELSE 5 END, total DESC, source_id) AS place FROM hh")
def health_sort(spark, sf):
    h = marts.source_health(read_table(spark, sf, "sources"), signals(spark, sf))
    return h.select("source_id", F.row_number().over(Window.orderBy(*marts.health_order())).cast("long").alias("place"))


@query(S + ", e AS (SELECT source_id, tier FROM s) SELECT source_id, count(*) AS total, count(*) FILTER (tier IN ('immediate','daily')) AS selected, CAST(floor((CAST(count(*) FILTER (tier IN ('immediate','daily')) AS DOUBLE)/count(*))*100+0.5) AS BIGINT) AS selected_rate FROM e GROUP BY 1")
def source_health_fallback(spark, sf):
    sel = F.count_if(F.col("tier").isin(*marts.SELECTED))
    g = signals(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), sel.alias("selected"))
    return g.withColumn("selected_rate", marts.rate(F.col("selected"), F.col("total"), half_even=False))


@query(S + """, c AS (SELECT seq, tier, source_ids, unnest(list_distinct(matched_company_ids)) AS company_id FROM s), e AS (SELECT seq, tier, company_id, unnest(list_distinct(source_ids)) AS source_id FROM c WHERE company_id<>''),
 g AS (SELECT company_id, source_id, count(*) AS total, count(*) FILTER (tier='immediate') AS immediate, count(*) FILTER (tier='daily') AS daily, count(*) FILTER (tier='archive') AS archive FROM e GROUP BY 1,2)
 SELECT *, CAST(floor((CAST(immediate+daily AS DOUBLE)/total)*100+0.5) AS BIGINT) AS selected_rate, CASE WHEN immediate+daily>0 THEN 'productive' ELSE 'archive_only' END AS status FROM g""")
def company_health(spark, sf):
    return marts.company_source_health(signals(spark, sf))


@query(S + """, d AS (SELECT c.id AS company_id, src.id AS source_id FROM companies c JOIN sources src ON src.company_id=c.id), e AS (SELECT seq, tier, pub, unnest(list_distinct(source_ids)) AS source_id FROM s),
 g AS (SELECT source_id, count(*) AS total, count(*) FILTER (tier IN ('immediate','daily')) AS selected, max(pub) AS last FROM e GROUP BY 1)
 SELECT c.id AS company_id, count(d.source_id) AS n_sources, count(g.source_id) AS n_producing, CAST(coalesce(sum(g.total),0) AS BIGINT) AS total, CAST(coalesce(sum(g.selected),0) AS BIGINT) AS selected, max(g.last) AS last_published
 FROM (SELECT DISTINCT id FROM companies) c LEFT JOIN d ON d.company_id=c.id LEFT JOIN g ON g.source_id=d.source_id GROUP BY 1""")
def coverage_slots(spark, sf):
    src = read_table(spark, sf, "sources").select(F.col("id").alias("source_id"), "company_id")
    g = marts.by_source(signals(spark, sf)).select("source_id", "total", (F.col("immediate") + F.col("daily")).alias("sel"), "last_published", F.lit(1).alias("p"))
    c = read_table(spark, sf, "companies").select(F.col("id").alias("company_id")).distinct()
    j = c.join(src.join(g, "source_id", "left"), "company_id", "left")
    return j.groupBy("company_id").agg(
        F.count("source_id").alias("n_sources"), F.count("p").alias("n_producing"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("sel"), F.lit(0)).alias("selected"), F.max("last_published").alias("last_published"),
    )


@query(S + "".join((", " if i == 0 else " UNION ALL ") + ("x AS (" if i == 0 else "") + f"(SELECT '{f}' AS facet, {c} AS label, count(*) AS n FROM s WHERE {c} IS NOT NULL AND {c}<>'' GROUP BY {c} ORDER BY count(*) DESC, min(seq) LIMIT 1)" for i, (f, c) in enumerate((("event", "business_event_type"), ("company", "company_id"), ("source", "source_id"), ("action", "action"), ("category", "category")))) + ") SELECT * FROM x")
def executive_brief(spark, sf):
    s = signals(spark, sf)
    out = None
    for facet, column in (("event", "business_event_type"), ("company", "company_id"), ("source", "source_id"), ("action", "action"), ("category", "category")):
        t = marts.top1(s, facet, column)
        out = t if out is None else out.unionByName(t)
    return out


_ROLE = """, r AS (SELECT s.seq, max(CASE c.business_role WHEN 'customer' THEN 3 WHEN 'competitor' THEN 2 WHEN 'self' THEN 1 END) AS m FROM (SELECT seq, unnest(matched_company_ids) AS id FROM s) s JOIN (SELECT DISTINCT id, business_role FROM companies) c USING (id) GROUP BY 1),
 ro AS (SELECT s.*, CASE coalesce(m,0) WHEN 3 THEN 'customer' WHEN 2 THEN 'competitor' WHEN 1 THEN 'self' ELSE 'industry' END AS role FROM s LEFT JOIN r USING (seq))"""


def _with_role(spark, sf):
    s = signals(spark, sf)
    c = read_table(spark, sf, "companies").select("id", "business_role").dropDuplicates(["id"])
    e = s.select("seq", F.explode(F.array_distinct("matched_company_ids")).alias("id")).join(small_side(c), "id")
    rank = F.when(F.col("business_role") == "customer", 3).when(F.col("business_role") == "competitor", 2).when(F.col("business_role") == "self", 1)
    m = e.groupBy("seq").agg(F.max(rank).alias("m"))
    role = F.when(F.col("m") == 3, "customer").when(F.col("m") == 2, "competitor").when(F.col("m") == 1, "self").otherwise("industry")
    return s.join(m, "seq", "left").withColumn("role", role).drop("m")


@query(S + _ROLE + " SELECT seq, role FROM ro")
def item_role(spark, sf):
    return _with_role(spark, sf).select("seq", "role")


@query(S + _ROLE + " SELECT count(*) FILTER (relevance='high' AND tier IN ('immediate','daily')) AS high_selected, count(*) FILTER (role='competitor') AS competitor, count(*) FILTER (role='customer') AS customer, count(*) FILTER (role='industry') AS industry FROM ro")
def overview_kpis(spark, sf):
    r = _with_role(spark, sf)
    return r.agg(
        F.count_if((F.col("relevance") == "high") & F.col("tier").isin(*marts.SELECTED)).alias("high_selected"),
        *[F.count_if(F.col("role") == x).alias(x) for x in ("competitor", "customer", "industry")],
    )


@query(S + _ROLE + """, l AS (SELECT 'competitor' AS lane, seq, score FROM ro WHERE role='competitor' UNION ALL SELECT 'opportunity', seq, score FROM ro WHERE action='lead' OR (relevance='high' AND role<>'competitor') UNION ALL SELECT 'partner', seq, score FROM ro WHERE category='partnership')
 SELECT lane, seq, CAST(score AS BIGINT) AS score FROM l QUALIFY row_number() OVER (PARTITION BY lane ORDER BY score DESC, seq)<=3""")
def lane_top3(spark, sf):
    r = _with_role(spark, sf).select("seq", "score", "role", "action", "relevance", "category")
    lane = lambda name, cond: F.when(cond, F.lit(name))
    lanes = F.array_compact(F.array(
        lane("competitor", F.col("role") == "competitor"),
        lane("opportunity", F.coalesce(F.col("action") == "lead", F.lit(False)) | (F.coalesce(F.col("relevance") == "high", F.lit(False)) & (F.col("role") != "competitor"))),
        lane("partner", F.col("category") == "partnership"),
    ))
    e = r.select(F.explode(lanes).alias("lane"), "seq", F.col("score").cast("long").alias("score"))
    return marts.top_per_key(e, "lane", [F.desc("score"), "seq"], 3).drop("rank")


@query(S + "SELECT business_event_type AS k, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, k LIMIT 6")
def event_top6(spark, sf):
    return marts.mix(signals(spark, sf), "business_event_type").orderBy(F.desc("n"), "k").limit(6)


@query(S + f""", c AS (SELECT DISTINCT id, parent_company_id, coalesce(competitive_relevance_rank,1000000) AS rnk FROM companies WHERE business_role='competitor'),
 e AS (SELECT seq, tier, business_event_type, unnest(list_distinct(matched_company_ids)) AS id, matched_company_ids AS ids FROM s WHERE {range_sql(90)}),
 j AS (SELECT e.*, c.rnk, coalesce(p.id IS NOT NULL AND list_contains(ids,c.parent_company_id),false) AS brand FROM e JOIN c USING (id) LEFT JOIN c p ON p.id=c.parent_company_id),
 o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY seq ORDER BY NOT brand, CASE WHEN brand THEN 0 ELSE rnk END, id)=1),
 t AS (SELECT business_event_type FROM o GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
 m AS (SELECT id AS company_id, business_event_type AS event_type, count(*) AS n, count(*) FILTER (tier IN ('immediate','daily')) AS selected FROM o WHERE business_event_type IN (SELECT * FROM t) GROUP BY 1,2)
 SELECT *, CAST(ceil(4*n/CAST(max(n) OVER () AS DOUBLE)) AS BIGINT) AS intensity FROM m""")
def company_event_matrix(spark, sf):
    return marts.company_event_matrix(signals(spark, sf), read_table(spark, sf, "companies"), AS_OF)


_TYPES = ["news", "event", "research", "regulatory"]


@query(S + f""", d AS (SELECT CAST(unnest(generate_series({DAY}-INTERVAL 13 DAY, {DAY}, INTERVAL 1 DAY)) AS DATE) AS day), k AS (SELECT unnest({_TYPES}) AS k),
 c AS (SELECT {DAY}-CAST(greatest(coalesce({DAY}-pub,0),0) AS INTEGER) AS day, signal_type AS k, count(*) AS n FROM s GROUP BY 1,2) SELECT d.day, k.k, coalesce(c.n,0) AS n FROM d CROSS JOIN k LEFT JOIN c ON c.day=d.day AND c.k=k.k""")
def signal_trend(spark, sf):
    return marts.signal_trend(signals(spark, sf), AS_OF, 14, _TYPES, "signal_type")


_EV = "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1"


def _event_days(spark, sf):
    return read_table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT day, n, lag(n) OVER w AS previous, n-lag(n) OVER w AS delta, CASE WHEN n>lag(n) OVER w THEN 'up' WHEN n<lag(n) OVER w THEN 'down' WHEN n=lag(n) OVER w THEN 'flat' END AS direction FROM ({_EV}) WINDOW w AS (ORDER BY day)")
def day_over_day(spark, sf):
    return marts.day_over_day(_event_days(spark, sf))


@query(f"SELECT day, n FROM ({_EV}) ORDER BY day DESC LIMIT 10")
def history_retention(spark, sf):
    return marts.retained(_event_days(spark, sf), "day", 10)


@query(S + f"SELECT seq, CAST(score AS BIGINT) AS score FROM s WHERE {range_sql(60)} AND tier IN ('daily','immediate') AND relevance IN ('high','medium') AND contains(lower(concat_ws(' ',title,summary,source_label,business_event_type)),'trial')")
def dashboard_query(spark, sf):
    q = gates.SignalQuery(AS_OF, days=60, tiers=["daily", "immediate"], relevance=["high", "medium"], text="Trial")
    return q.apply(signals(spark, sf)).select("seq", F.col("score").cast("long").alias("score"))


@query(S + "SELECT seq FROM s WHERE list_contains(source_ids,'wire_hub_global')")
def source_drilldown(spark, sf):
    return gates.SignalQuery(AS_OF, days=1, source="wire_hub_global").apply(signals(spark, sf)).select("seq")


@query("SELECT doc_id FROM documents WHERE contains(lower(text),'potency assay')")
def fulltext_search(spark, sf):
    return read_table(spark, sf, "documents").filter(F.lower("text").contains("potency assay")).select("doc_id")


@query(S + "SELECT source_id, seq, rank FROM (SELECT source_id, seq, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, seq) AS BIGINT) AS rank FROM s) WHERE rank<=3")
def source_top3(spark, sf):
    s = signals(spark, sf).select("source_id", "seq", "score")
    return marts.top_per_key(s, "source_id", [F.desc("score"), "seq"], 3).select("source_id", "seq", F.col("rank").cast("long").alias("rank"))


@query("SELECT id, CAST(row_number() OVER (ORDER BY CASE business_role WHEN 'self' THEN 0 WHEN 'competitor' THEN 1 WHEN 'customer' THEN 2 ELSE 3 END, competitive_relevance_rank NULLS LAST, display_name, id) AS BIGINT) AS place FROM companies")
def company_sort(spark, sf):
    c = read_table(spark, sf, "companies")
    role = F.when(F.col("business_role") == "self", 0).when(F.col("business_role") == "competitor", 1).when(F.col("business_role") == "customer", 2).otherwise(3)
    w = Window.orderBy(role, F.asc_nulls_last("competitive_relevance_rank"), "display_name", "id")
    return c.select("id", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT business_role, count(*) AS n, count(*) FILTER (parent_company_id IS NOT NULL) AS n_children, count(*) FILTER (competitive_relevance_rank IS NOT NULL) AS n_ranked FROM companies GROUP BY 1")
def company_pools(spark, sf):
    return read_table(spark, sf, "companies").groupBy("business_role").agg(
        F.count(F.lit(1)).alias("n"), F.count("parent_company_id").alias("n_children"), F.count("competitive_relevance_rank").alias("n_ranked")
    )


# ---- state


def _keys(spark, sf):
    s = signals(spark, sf)
    return s.select(U.url_key(F.col("url")).alias("key"), "seq", "source_id", "title", "run_date")


_KEYS = S + f", k AS (SELECT left(sha256({NORM}),16) AS key, seq, source_id, title, run_date FROM s)"


@query(_KEYS + " SELECT key, min(seq) AS seq FROM k WHERE key IS NOT NULL AND run_date>DATE '2026-03-01' AND key NOT IN (SELECT key FROM k WHERE run_date<=DATE '2026-03-01' AND key IS NOT NULL) GROUP BY 1")
def seen_antijoin(spark, sf):
    k = _keys(spark, sf).filter("key is not null")
    old, new = k.filter("run_date <= '2026-03-01'"), k.filter("run_date > '2026-03-01'")
    fresh = state.flag_new(new, old).filter("is_new")
    return fresh.groupBy("key").agg(F.min("seq").alias("seq"))


@query(_KEYS + " SELECT DISTINCT source_id, key FROM k WHERE key IS NOT NULL AND run_date>DATE '2026-06-01' AND source_id IN (SELECT source_id FROM k WHERE run_date<=DATE '2026-06-01') AND (source_id,key) NOT IN (SELECT source_id, key FROM k WHERE run_date<=DATE '2026-06-01' AND key IS NOT NULL AND source_id IS NOT NULL)")
def snapshot_diff(spark, sf):
    k = _keys(spark, sf).filter("key is not null")
    return state.snapshot_diff(k.filter("run_date > '2026-06-01'"), k.filter("run_date <= '2026-06-01'").select("source_id", "key"))


@query(_KEYS + ", e AS (SELECT key, max(title) AS et FROM k WHERE run_date<=DATE '2026-03-01' AND key IS NOT NULL GROUP BY 1) SELECT k.seq, coalesce(et,title) AS title, et IS NOT NULL AS reused FROM k LEFT JOIN e USING (key) WHERE run_date>DATE '2026-03-01'")
def summary_reuse(spark, sf):
    k = _keys(spark, sf)
    earlier = k.filter("run_date <= '2026-03-01' and key is not null").groupBy("key").agg(F.max("title").alias("title"))
    return state.reuse(k.filter("run_date > '2026-03-01'"), earlier, "key", "title").select("seq", "title", "reused")


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC)=1) WHERE event_type<>'error'")
def feedback_latest(spark, sf):
    e = read_table(spark, sf, "events").select("user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("v"), "event_type")
    last = e.groupBy("user_id").agg(F.max_by("v", F.struct("ts", "event_type")).alias("event_type"))
    return last.filter("event_type <> ''")


@query("SELECT user_id, event_type, min(ts) AS first_ts, count(*) AS n FROM events GROUP BY 1,2")
def streaming_dedupe_batch_twin(spark, sf):
    return read_table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))


# ---- probe, customers, relations, validation


@query(S + f""", i AS (SELECT DISTINCT candidate_id AS seq, title, url, source_id FROM incoming_candidates), x AS (SELECT seq, source_id, {NORM} AS u, {title_key_sql('title')} AS t FROM i),
 h AS (SELECT {NORM} AS u, {title_key_sql('title')} AS t FROM s), n AS (SELECT x.* FROM x WHERE (u IS NULL OR u NOT IN (SELECT u FROM h WHERE u IS NOT NULL)) AND (t IS NULL OR t NOT IN (SELECT t FROM h WHERE t IS NOT NULL)))
 SELECT x.source_id, count(*) AS total, count(n.seq) AS new_items FROM x LEFT JOIN n USING (seq) GROUP BY 1""")
def probe_report(spark, sf):
    s = signals(spark, sf)
    have_u = s.select(U.normalize_url(F.col("url")).alias("u")).filter("u is not null").distinct()
    have_t = s.select(X.title_key(F.col("title")).alias("t")).distinct()
    i = read_table(spark, sf, "incoming_candidates").dropDuplicates(["candidate_id"])
    x = i.select(F.col("candidate_id").alias("seq"), "source_id", U.normalize_url(F.col("url")).alias("u"), X.title_key(F.col("title")).alias("t"))
    new = x.join(have_u, "u", "left_anti").join(have_t, "t", "left_anti").select("seq", F.lit(1).alias("_n"))
    return x.join(new, "seq", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count("_n").alias("new_items"))


_CT = "trim(regexp_replace(translate(lower(coalesce({0},'')),'‐‑‒–—','-----'),'[^a-z0-9\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}&+.-]+',' ','g'))"


@query(S + f""", c AS (SELECT DISTINCT id, {_CT.format('display_name')} AS term FROM companies WHERE business_role='customer' AND length({_CT.format('display_name')})>=6)
 SELECT c.id, count(*) AS n, CAST(max(score) AS BIGINT) AS best FROM c JOIN s ON contains({_CT.format("coalesce(title,'')||' '||summary")}, c.term) GROUP BY 1""")
def customer_match(spark, sf):
    c = read_table(spark, sf, "companies").filter("business_role = 'customer'").select("id", X.customer_text(F.col("display_name")).alias("term")).distinct()
    c = c.filter(X.strong_term(F.col("term")))
    s = signals(spark, sf).select("score", X.customer_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), "summary")).alias("t"))
    j = s.join(small_side(c), F.col("t").contains(F.col("term")))
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("score").cast("long").alias("best"))


@query("SELECT n_name, c_mktsegment, count(*) AS n, CAST(round(sum(c_acctbal)*100) AS BIGINT) AS cents FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE c_acctbal>0 GROUP BY 1,2")
def customer_directory(spark, sf):
    c, n = read_table(spark, sf, "customer").filter("c_acctbal > 0"), read_table(spark, sf, "nation")
    j = c.join(small_side(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal") * 100).cast("long").alias("cents"))


@query()
def relationship_candidates(spark, sf):
    """Two-sided headlines of partnership signals: source company, counterparty, best score first, one per pair."""
    s = signals(spark, sf).filter((F.col("category") == "partnership") & F.col("tier").isin(*marts.SELECTED))
    c = read_table(spark, sf, "companies").select(F.col("id").alias("cid"), X.short_name(F.col("display_name")).alias("source")).dropDuplicates(["cid"])
    j = s.withColumn("cid", F.get("matched_company_ids", F.lit(0))).join(small_side(c), "cid")
    j = j.withColumn("other", X.counterparty(F.col("title"), F.col("source"))).filter(X.plausible_entity(F.col("other")))
    j = j.filter(~X.entity_text(F.col("source")).contains(X.entity_text(F.col("other"))))
    pairs = j.select("cid", X.entity_text(F.col("other")).alias("k"), "other", "seq", "score")
    return dedupe.best_per_key(pairs, ["cid", "k"], [-F.col("score"), "seq"]).select("cid", "other", "seq", F.col("score").cast("long").alias("score"))


_GR = """WITH r AS (SELECT DISTINCT id, hub_company_id, lower(trim(organization)) AS o, relationship_type, topics FROM company_relationships WHERE organization IS NOT NULL AND organization<>''),
 e AS (SELECT 'hub:'||hub_company_id AS src, 'org:'||o AS dst, relationship_type AS type FROM r UNION SELECT 'org:'||o, 'topic:'||unnest(topics), 'topic' FROM r
 UNION SELECT h, 'company:'||c.id, 'competitor' FROM (SELECT DISTINCT 'hub:'||hub_company_id AS h FROM r) CROSS JOIN companies c WHERE c.business_role='competitor')
"""


def _graph(spark, sf):
    return graph.graph(read_table(spark, sf, "company_relationships"), read_table(spark, sf, "companies"))


@query(_GR + "SELECT src, dst, type FROM e WHERE dst IS NOT NULL")
def graph_edges(spark, sf):
    return _graph(spark, sf)[1].select("src", "dst", "type")


@query(_GR + "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e WHERE dst IS NOT NULL UNION ALL SELECT dst FROM e WHERE dst IS NOT NULL) GROUP BY 1")
def graph_degree(spark, sf):
    return graph.degrees(_graph(spark, sf)[1])


@query(_GR + "SELECT dst AS node, type FROM e WHERE src='hub:co_dogelufanil_instruments' AND type='investor'")
def graph_focus(spark, sf):
    nodes, edges = _graph(spark, sf)
    _, seen = graph.induced(nodes, edges, F.col("kind").isin("hub", "org"))
    return graph.neighbours(seen, "hub:co_dogelufanil_instruments").filter("type = 'investor'")


@query("SELECT relationship_type, evidence_level, count(*) AS n FROM (SELECT DISTINCT id, relationship_type, evidence_level FROM company_relationships) GROUP BY 1,2")
def relationship_filter_counts(spark, sf):
    return read_table(spark, sf, "company_relationships").select("id", "relationship_type", "evidence_level").distinct().groupBy("relationship_type", "evidence_level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, i, o_orderkey, o_orderstatus FROM (SELECT o_custkey AS c_custkey, unnest(range(1,len(k)+1)) AS i, unnest(k) AS o_orderkey, unnest(st) AS o_orderstatus FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_orderstatus ORDER BY o_orderkey) AS st FROM orders GROUP BY 1)) WHERE o_orderstatus IN ('F','O')")
def zip_filings(spark, sf):
    """Parallel arrays, zipped by position, as filing feeds deliver them."""
    o = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    p = o.select(F.col("o_custkey").alias("c_custkey"), F.col("x.o_orderkey").alias("k"), F.col("x.o_orderstatus").alias("st"))
    z = p.select("c_custkey", F.posexplode(F.arrays_zip("k", "st")).alias("i", "z"))
    return z.select("c_custkey", (F.col("i") + 1).cast("long").alias("i"), F.col("z.k").alias("o_orderkey"), F.col("z.st").alias("o_orderstatus")).filter("o_orderstatus in ('F','O')")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props,'$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props(spark, sf):
    e = read_table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


@query("SELECT r.id, string_agg(DISTINCT t,'; ' ORDER BY t) AS topics FROM (SELECT id, unnest(topics) AS t FROM company_relationships) r WHERE t IS NOT NULL GROUP BY 1")
def nested_flatten(spark, sf):
    r = read_table(spark, sf, "company_relationships").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("t"))
    return r.select("id", F.array_join(F.filter("t", lambda x: x.isNotNull()), "; ").alias("topics")).filter("topics <> ''")


@query(S + """, v AS (SELECT 'duplicate_ids' AS chk, (SELECT count(*) FROM (SELECT seq FROM s GROUP BY 1 HAVING count(*)>1)) AS n UNION ALL SELECT 'duplicate_urls', (SELECT count(*) FROM (SELECT url FROM s WHERE url IS NOT NULL GROUP BY 1 HAVING count(*)>1))
 UNION ALL SELECT 'duplicate_sources', (SELECT count(*) FROM (SELECT id FROM sources GROUP BY 1 HAVING count(*)>1)) UNION ALL SELECT 'orphan_companies', (SELECT count(*) FROM (SELECT seq, unnest(list_distinct(matched_company_ids)) AS id FROM s) WHERE id<>'' AND id NOT IN (SELECT id FROM companies))
 UNION ALL SELECT 'orphan_sources', (SELECT count(*) FROM (SELECT seq, unnest(list_distinct(source_ids)) AS id FROM s) WHERE id<>'' AND id NOT IN (SELECT id FROM sources)) UNION ALL SELECT 'event_type_enum', (SELECT count(*) FROM s WHERE business_event_type IS NULL OR business_event_type NOT IN ('quality_supply','customer_demand','partnership_deal','clinical_regulatory','market_activity','regional_expansion','product_platform','target_therapy','corporate_strategy'))
 UNION ALL SELECT 'tier_enum', (SELECT count(*) FROM s WHERE tier IS NULL OR tier NOT IN ('immediate','daily','archive')) UNION ALL SELECT 'negative_score', (SELECT count(*) FROM s WHERE score<0) UNION ALL SELECT 'low_in_feed', (SELECT count(*) FROM s WHERE relevance='low' AND tier<>'archive')
 UNION ALL SELECT 'unknown_parents', (SELECT count(*) FROM companies WHERE parent_company_id IS NOT NULL AND parent_company_id NOT IN (SELECT id FROM companies))) SELECT chk, n FROM v""")
def validator_violations(spark, sf):
    from tidemark.operators import validate

    return validate.violations(signals(spark, sf), read_table(spark, sf, "sources"), read_table(spark, sf, "companies"))


@query(S + "SELECT seq, CAST(score AS BIGINT) AS score, tier FROM s ORDER BY tier<>'immediate', score DESC, seq LIMIT 50")
def flagship_signals(spark, sf):
    s = signals(spark, sf).select("seq", F.col("score").cast("long").alias("score"), "tier")
    return s.orderBy(F.col("tier") != "immediate", F.desc("score"), "seq").limit(50)

"""Queries of the source library, coverage, boards and labels. Their SQL is written out, without the engine's constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import library, marts, terms
from tidemark.plans.signal_queries import DAY, S, range_sql, signals, today
from tidemark.functions import dates as D
from tidemark.session import read_table, small_side

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _errors(spark, sf):
    """Stand-in for a run's errors: sources that were taken out."""
    return read_table(spark, sf, "sources").filter("removed_at is not null").select(F.col("id").alias("source_id"), F.lit("HTTP 410").alias("error"))


def _runtime(spark, sf):
    return signals(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("url").contains("/new")).alias("new_urls"))


def _sources(spark, sf):
    """The sources; those of trust owned belong to the least company that their items declare."""
    own = signals(spark, sf).filter("coalesce(company_id,'') <> ''").groupBy("source_id").agg(F.min("company_id").alias("_o")).withColumnRenamed("source_id", "id")
    src = read_table(spark, sf, "sources").dropDuplicates(["id"]).join(small_side(own), "id", "left")
    return src.withColumn("company_id", F.coalesce("company_id", F.when(F.col("trust") == "owned", F.col("_o")))).drop("_o")


def _health(spark, sf):
    return library.full_health(_sources(spark, sf), signals(spark, sf), _errors(spark, sf), _runtime(spark, sf), read_table(spark, sf, "companies"))


def _catalogue(spark, sf):
    """A method per source type and trust, named after its first source."""
    c = read_table(spark, sf, "sources").dropDuplicates(["id"]).groupBy("type", "trust").agg(F.array_sort(F.collect_set("id")).alias("source_ids"), F.max("enabled").alias("_e"), F.max("archive_only").alias("_a"))
    status = F.when(~F.col("_e"), "planned").when(F.col("_a"), "manual").otherwise("active")
    name = F.concat(F.replace(F.get("source_ids", F.lit(0)), F.lit("_"), F.lit(" ")), F.lit(" feed"))
    return c.select(F.concat_ws(":", "type", "trust").alias("method_id"), F.col("trust").alias("layer"), status.alias("status"), name.alias("name"), F.concat(F.lit("see "), "type").alias("note"), "source_ids")


def _slots(spark, sf):
    """Stand-in for coverage profiles: of each declared company a slot per signal type, with its sources and one that isn't configured."""
    g = signals(spark, sf).filter("coalesce(company_id,'') <> ''").groupBy("company_id", F.col("signal_type").alias("slot")).agg(F.collect_set("source_id").alias("ids"), F.max(F.col("tier") != "archive").alias("_e"))
    return g.select("company_id", "slot", F.when(F.col("_e"), "active").otherwise("gap").alias("slot_status"), F.concat("ids", F.array(F.lit("no_such_source"))).alias("source_ids"))


H = S + """, own AS (SELECT source_id, min(company_id) AS o FROM s WHERE coalesce(company_id,'')<>'' GROUP BY 1), src AS (SELECT z.* REPLACE (coalesce(z.company_id, CASE WHEN z.trust='owned' THEN own.o END) AS company_id) FROM (SELECT DISTINCT ON (id) * FROM sources) z LEFT JOIN own ON own.source_id=z.id), co AS (SELECT DISTINCT ON (id) * FROM companies), er AS (SELECT id AS source_id, 'HTTP 410' AS error FROM src WHERE removed_at IS NOT NULL),
 rt AS (SELECT source_id, count(*) AS raw, count(*) FILTER (contains(url,'/new')) AS new_urls FROM s GROUP BY 1),
 pe AS (SELECT seq, tier, pub, unnest(list_distinct(source_ids)) AS source_id FROM s),
 pg AS (SELECT source_id, count(*) AS total, count(*) FILTER (tier='immediate') AS immediate, count(*) FILTER (tier='daily') AS daily, count(*) FILTER (tier='archive') AS archive, max(pub) AS last_published FROM pe GROUP BY 1),
 h0 AS (SELECT src.id AS source_id, src.label AS source_label, coalesce(src.company_id,'') AS company_id, CASE WHEN coalesce(src.company_id,'')<>'' THEN co.display_name ELSE src.scope_label END AS scope,
 src.type AS source_type, coalesce(src.signal_type,'news') AS signal_type, coalesce(src.enabled,true) AS enabled, coalesce(total,0) AS total, coalesce(immediate,0) AS immediate, coalesce(daily,0) AS daily,
 coalesce(archive,0) AS archive, last_published, coalesce(er.error,'') AS error, coalesce(raw,0) AS raw, coalesce(new_urls,0) AS new_urls
 FROM src LEFT JOIN pg ON pg.source_id=src.id LEFT JOIN er ON er.source_id=src.id LEFT JOIN rt ON rt.source_id=src.id LEFT JOIN co ON co.id=src.company_id),
 h AS (SELECT *, CASE WHEN NOT enabled THEN 'pending' WHEN error<>'' THEN 'error' WHEN immediate+daily>0 THEN 'productive' WHEN total>0 THEN 'archive_only' ELSE 'quiet' END AS status FROM h0),
 cat AS (SELECT type||':'||trust AS method_id, trust AS layer, CASE WHEN NOT bool_or(enabled) THEN 'planned' WHEN bool_or(archive_only) THEN 'manual' ELSE 'active' END AS status,
 replace(min(id),'_',' ')||' feed' AS name, 'see '||type AS note, list(id) AS source_ids FROM src GROUP BY type, trust),
 sl AS (SELECT company_id, signal_type AS slot, CASE WHEN bool_or(tier<>'archive') THEN 'active' ELSE 'gap' END AS slot_status, list_append(list(DISTINCT source_id),'no_such_source') AS source_ids FROM s WHERE coalesce(company_id,'')<>'' GROUP BY 1,2)
"""


@query(H + """ SELECT source_id, source_label, company_id, scope, source_type, signal_type, enabled, status, CASE WHEN NOT enabled THEN 'not_running' WHEN error<>'' THEN 'error' ELSE 'reachable' END AS operational_status,
 CASE WHEN status IN ('error','pending') THEN 'none' ELSE status END AS output_status, total, immediate, daily, archive,
 CASE WHEN total=0 THEN 0 ELSE CAST(round_even((CAST(immediate+daily AS DOUBLE)/total)*100,0) AS BIGINT) END AS selected_rate, last_published, error, raw, new_urls FROM h""")
def source_health_full(spark, sf):
    return _health(spark, sf)


@query(H + " SELECT 'effective' AS view, source_id FROM h WHERE enabled AND status='productive' AND company_id='' UNION ALL SELECT 'connected', source_id FROM h WHERE enabled AND status='error'")
def source_view(spark, sf):
    h = _health(spark, sf)
    a = library.view(h, "effective", "shared").select(F.lit("effective").alias("view"), "source_id")
    return a.unionByName(library.view(h, "connected", "error").select(F.lit("connected").alias("view"), "source_id"))


@query(H + """ SELECT CASE WHEN company_id<>'' THEN 'dedicated' ELSE 'shared' END AS board, source_id, CAST(row_number() OVER (PARTITION BY company_id<>'' ORDER BY immediate+daily DESC, total DESC, source_label, source_id) AS INTEGER) AS rank FROM h""")
def runtime_board(spark, sf):
    return library.board(_health(spark, sf)).select("board", "source_id", "rank")


@query("SELECT DISTINCT id AS source_id FROM sources WHERE contains(lower(id),'wire') OR contains(lower(id),'lab')")
def probe_selection(spark, sf):
    return library.probed(read_table(spark, sf, "sources"), ["WIRE", "lab"]).select(F.col("id").alias("source_id")).distinct()


@query(H + " SELECT source_id, min(method_id) AS method_id, arg_min(layer, method_id) AS layer FROM (SELECT method_id, layer, unnest(source_ids) AS source_id FROM cat) GROUP BY 1")
def catalogue_methods(spark, sf):
    return library.of_sources(_catalogue(spark, sf)).select("source_id", "method_id", "layer")


@query(H + """, l AS (SELECT c.method_id, h.* FROM (SELECT method_id, unnest(source_ids) AS sid FROM cat) c JOIN h ON h.source_id=c.sid)
 SELECT method_id, CASE WHEN count(*) FILTER (status='pending')>0 THEN 'pending' WHEN count(*) FILTER (status='error')>0 THEN 'error' WHEN sum(total)>0 THEN 'items' ELSE 'none' END AS state,
 CAST(sum(total) AS BIGINT) AS total, CAST(sum(immediate+daily) AS BIGINT) AS selected, CAST(sum(archive) AS BIGINT) AS archive, max(last_published) AS latest FROM l GROUP BY 1""")
def live_source_result(spark, sf):
    return library.live_result(_catalogue(spark, sf), _health(spark, sf))


@query(H + """ SELECT layer, count(*) FILTER (status='active') AS visible, count(*) AS total, count(*) FILTER (status='active') AS active, 0::BIGINT AS available, 0::BIGINT AS planned, 0::BIGINT AS manual, 0::BIGINT AS covered,
 0::BIGINT AS blocked, 0::BIGINT AS paid FROM cat GROUP BY ROLLUP(layer) HAVING count(*) FILTER (status='active')>0""")
def method_library(spark, sf):
    return library.methods(_catalogue(spark, sf), "active")


@query(H + " SELECT count(*) FILTER (status='error') AS error, count(*) FILTER (status='pending') AS pending, count(*) FILTER (status='quiet') AS quiet, count(*) FILTER (status='archive_only') AS archive_only, count(*) FILTER (status='productive') AS productive, count(*) FILTER (status IN ('pending','error')) AS attention FROM h WHERE enabled")
def source_view_metrics(spark, sf):
    return library.status_strip(_health(spark, sf).filter("enabled"))


@query(H + " SELECT h.source_id, h.error AS message, coalesce(arg_min(c.note, c.method_id),'') AS note FROM h LEFT JOIN cat c ON contains(lower(c.name), lower(replace(h.source_id,'_',' '))) WHERE h.status='error' GROUP BY 1,2")
def health_strip_errors(spark, sf):
    return library.failed(_health(spark, sf), _catalogue(spark, sf))


_COV = H + """, w AS (SELECT company_id AS c, slot, unnest(list_distinct(source_ids)) AS source_id FROM sl),
 m AS (SELECT seq, tier, unnest(list_distinct(matched_company_ids)) AS c, source_ids FROM s), ms AS (SELECT seq, tier, c, unnest(list_distinct(source_ids)) AS source_id FROM m),
 mg AS (SELECT c, source_id, count(*) AS total, count(*) FILTER (tier IN ('immediate','daily')) AS selected, count(*) FILTER (tier='archive') AS archive FROM ms GROUP BY 1,2),
 ly AS (SELECT source_id, arg_min(layer, method_id) AS layer FROM (SELECT method_id, layer, unnest(source_ids) AS source_id FROM cat) GROUP BY 1),
 cr AS (SELECT w.c AS company_id, w.slot, w.source_id, CASE WHEN h.company_id=w.c THEN 'dedicated' ELSE 'shared' END AS scope, coalesce(ly.layer,'unsorted') AS layer,
 CASE WHEN coalesce(h.status,'pending') IN ('error','pending') THEN coalesce(h.status,'pending') WHEN coalesce(mg.selected,0)>0 THEN 'productive' WHEN coalesce(mg.total,0)>0 THEN 'archive_only' ELSE 'quiet' END AS status,
 coalesce(mg.total,0) AS total, coalesce(mg.selected,0) AS selected, coalesce(mg.archive,0) AS archive
 FROM w LEFT JOIN h ON h.source_id=w.source_id LEFT JOIN mg ON mg.c=w.c AND mg.source_id=w.source_id LEFT JOIN ly ON ly.source_id=w.source_id)
"""


@query(_COV + " SELECT * FROM cr")
def coverage_source_rows(spark, sf):
    return library.coverage_rows(_slots(spark, sf), _health(spark, sf), signals(spark, sf), _catalogue(spark, sf))


@query(_COV + """ SELECT n.company_id, coalesce(dedicated,0) AS dedicated, coalesce(shared,0) AS shared, n.covered, greatest(0, 5-n.covered) AS gaps FROM (SELECT company_id, count(DISTINCT CASE WHEN slot_status IN ('active','covered') THEN slot END) AS covered FROM sl GROUP BY 1) n
 LEFT JOIN (SELECT company_id, count(DISTINCT source_id) FILTER (scope='dedicated') AS dedicated, count(DISTINCT source_id) FILTER (scope='shared') AS shared FROM cr GROUP BY 1) x ON x.company_id=n.company_id""")
def coverage_page(spark, sf):
    slots = _slots(spark, sf)
    return library.coverage_page(slots, library.coverage_rows(slots, _health(spark, sf), signals(spark, sf), _catalogue(spark, sf)), 5)


@query("""WITH c AS (SELECT DISTINCT ON (id) id, business_role, split_part(display_name,' / ',1) AS n, CASE WHEN competitive_relevance_rank>0 THEN competitive_relevance_rank ELSE 2147483647 END AS r FROM companies)
 SELECT d.role, count(c.id) AS n, coalesce(string_agg(c.n,' | ' ORDER BY c.r, c.n, c.id),'') AS members FROM (VALUES ('self'),('competitor'),('customer'),('partner')) d(role) LEFT JOIN c ON c.business_role=d.role GROUP BY 1""")
def company_dock(spark, sf):
    name = F.get(F.split("display_name", " / "), F.lit(0))
    return library.dock(read_table(spark, sf, "companies"), ["self", "competitor", "customer", "partner"], name, F.col("competitive_relevance_rank"))


@query("SELECT DISTINCT id, CASE WHEN competitive_relevance_rank IS NULL OR competitive_relevance_rank<=0 THEN '--' WHEN competitive_relevance_rank<10 THEN '0'||CAST(CAST(competitive_relevance_rank AS INTEGER) AS VARCHAR) ELSE CAST(CAST(competitive_relevance_rank AS INTEGER) AS VARCHAR) END AS rank FROM companies")
def rank_format(spark, sf):
    return read_table(spark, sf, "companies").select("id", L.rank_text(F.col("competitive_relevance_rank").cast("int")).alias("rank")).distinct()


@query(S + """ SELECT seq, CASE tier WHEN 'immediate' THEN '即时提醒' WHEN 'daily' THEN '进入日报' WHEN 'archive' THEN '归档观察' ELSE tier END AS tier,
 CASE category WHEN 'partnership' THEN '合作 / 伙伴' WHEN 'product' THEN '产品 / 技术' WHEN 'event' THEN '展会 / 活动' WHEN 'regulatory' THEN '监管 / 申报' WHEN 'finance' THEN '资本 / 财务' WHEN 'award' THEN '奖项 / 认可'
 WHEN 'market' THEN '市场扩张' WHEN 'company' THEN '公司动态' WHEN 'video' THEN '视频 / Webinar' WHEN 'research' THEN '论文 / 研究' WHEN 'uncategorized' THEN '未分类' ELSE category END AS category,
 CASE signal_type WHEN 'news' THEN '新闻' WHEN 'event' THEN '活动 / 生态' WHEN 'video' THEN '视频' WHEN 'filing' THEN '公司公告' WHEN 'regulatory' THEN '监管风险' WHEN 'funding' THEN '研发资助 / 政策' WHEN 'research' THEN '论文研究' WHEN 'clinical_trial' THEN '临床试验' ELSE signal_type END AS signal_type FROM s""")
def enum_labels(spark, sf):
    return signals(spark, sf).select("seq", *[L.label(F.col(c), c).alias(c) for c in ("tier", "category", "signal_type")])


@query(S + """ SELECT business_event_type AS code, count(*) AS n, CASE business_event_type WHEN 'product_platform' THEN 'Product' WHEN 'target_therapy' THEN 'Targets' WHEN 'clinical_regulatory' THEN 'Clinical' WHEN 'partnership_deal' THEN 'Deals'
 WHEN 'customer_demand' THEN 'Demand' WHEN 'market_activity' THEN 'Events' WHEN 'regional_expansion' THEN 'Region' WHEN 'quality_supply' THEN 'Quality' WHEN 'corporate_strategy' THEN 'Strategy' ELSE business_event_type END AS short FROM s GROUP BY 1""")
def event_labels(spark, sf):
    return marts.mix(signals(spark, sf), "business_event_type", "code").withColumn("short", L.event_label(F.col("code"), english=True, short=True))


@query(S + """ SELECT seq, array_to_string(list_filter([CASE WHEN len(intelligence.targets)>0 THEN 'targets' END, CASE WHEN len(intelligence.modalities)>0 THEN 'modalities' END, CASE WHEN len(intelligence.product_needs)>0 THEN 'product_needs' END,
 CASE WHEN len(intelligence.development_stages)>0 THEN 'development_stages' END, CASE WHEN len(intelligence.business_actions)>0 THEN 'business_actions' END, CASE WHEN len(intelligence.event_signals)>0 THEN 'event_signals' END], lambda x: x IS NOT NULL),'|') AS filled FROM s""")
def ontology_nonempty(spark, sf):
    groups = ("targets", "modalities", "product_needs", "development_stages", "business_actions", "event_signals")
    i = F.col("intelligence")
    return signals(spark, sf).select("seq", F.concat_ws("|", *[F.when(F.size(i[g]) > 0, g) for g in groups]).alias("filled"))


@query("""SELECT DISTINCT candidate_id, strftime(fetched_at AT TIME ZONE 'UTC','%m/%d %H:%M') AS shown FROM (SELECT candidate_id, CAST(fetched_at AS TIMESTAMPTZ) AS fetched_at FROM candidates)""")
def timestamp_display(spark, sf):
    c = read_table(spark, sf, "candidates")
    return c.select("candidate_id", L.time_text(F.col("fetched_at").cast("string")).alias("shown")).distinct()


@query(S + f""" SELECT seq, CASE WHEN signal_type='event' AND pub IS NOT NULL THEN '活动 '||CAST(pub AS VARCHAR)||CASE WHEN pub-{DAY}>0 THEN ' · '||CAST(pub-{DAY} AS VARCHAR)||' 天后' WHEN pub={DAY} THEN ' · 今天' ELSE ' · '||CAST({DAY}-pub AS VARCHAR)||' 天前' END
 WHEN coalesce(published,'')<>'' THEN '发布 '||published ELSE '日期待核对' END AS shown FROM s""")
def date_labels(spark, sf):
    return signals(spark, sf).select("seq", L.date_text(F.when(F.col("signal_type") == "event", F.col("pub")), F.col("published"), today()).alias("shown"))


@query(S + r""" SELECT seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(source_labels, lambda x: x<>''),' + '),'company pool indexed RSS','公司池索引 RSS','gi'),
 'indexed RSS','索引 RSS','gi'),'\bbackup\b','备份','gi'),'official news','官网新闻','gi'),'official site','官网','gi'),'official Insights','官方 Insights','gi') AS shown FROM s WHERE source_labels IS NOT NULL""")
def source_label_text(spark, sf):
    s = signals(spark, sf).filter("source_labels is not null")
    return s.select("seq", L.source_names(F.col("source_labels"), chinese=True).alias("shown"))


@query(S + " SELECT seq, score FROM s WHERE tier IN ('immediate','daily') AND length(summary)>=60 ORDER BY tier<>'immediate', score DESC, seq LIMIT 10")
def summary_budget(spark, sf):
    wanted = F.col("tier").isin("immediate", "daily") & (F.length("summary") >= 60)
    return library.summary_budget(signals(spark, sf), wanted, 10).select("seq", "score")


@query(S + ", e AS (SELECT seq, score, unnest(list_distinct(matched_company_ids)) AS company_id FROM s) SELECT company_id, seq, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, seq) AS n FROM e WHERE company_id<>'') WHERE n<=5")
def first_signals(spark, sf):
    e = signals(spark, sf).select("seq", "score", F.explode(F.array_distinct("matched_company_ids")).alias("company_id")).filter("company_id <> ''")
    return marts.top_per_key(e, "company_id", [F.desc("score"), "seq"], 5).select("company_id", "seq", "rank")


@query("""WITH r AS (SELECT DISTINCT ON (id) id, relationship_type, evidence_level FROM company_relationships), d AS (SELECT 'candidate:'||CAST(candidate_id AS VARCHAR) AS id, 'candidate' AS relationship_type, 'inferred' AS evidence_level
 FROM (SELECT DISTINCT candidate_id FROM candidates WHERE category='partnership' AND tier IN ('immediate','daily'))) SELECT * FROM (SELECT * FROM r UNION ALL SELECT * FROM d) WHERE evidence_level IN ('confirmed','inferred')""")
def relations_with_candidates(spark, sf):
    r = read_table(spark, sf, "company_relationships").select("id", "relationship_type", "evidence_level").dropDuplicates(["id"])
    d = signals(spark, sf).filter((F.col("category") == "partnership") & F.col("tier").isin(*marts.SELECTED))
    d = d.select(F.concat(F.lit("candidate:"), "seq").alias("id"), F.lit("candidate").alias("relationship_type"), F.lit("inferred").alias("evidence_level"))
    return r.unionByName(d).filter(F.col("evidence_level").isin("confirmed", "inferred"))


@query("""WITH g AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1) SELECT 0 AS place, 'all customers' AS label, 'listed_pool' AS status, count(*) AS n FROM customer HAVING count(*)>0
 UNION ALL SELECT CAST(row_number() OVER (ORDER BY label) AS INTEGER), label, 'segment', n FROM g""")
def customer_segments(spark, sf):
    """The segments with the listed pool, if there is one, put before them."""
    c = read_table(spark, sf, "customer")
    seg = c.groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1))
    seg = marts.top_per_key(seg, "all", ["label"], 2**31 - 1).select(F.col("rank").alias("place"), "label", F.lit("segment").alias("status"), "n")
    pool = c.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(0).alias("place"), F.lit("all customers").alias("label"), F.lit("listed_pool").alias("status"), "n")
    return pool.unionByName(seg)


# ---- companies and topics as the pipeline resolves them

_TERM = """regexp_matches(b.t, CASE WHEN regexp_full_match(d.term,'[a-z0-9][a-z0-9 .+/-]*') THEN '(^|[^a-z0-9])'||regexp_escape(d.term)||'($|[^a-z0-9])' ELSE regexp_escape(d.term) END)"""
_MATCH = S + f""", b AS (SELECT seq, lower(coalesce(title,'')||' '||summary) AS t FROM s), d AS (SELECT DISTINCT id AS company_id, lower(trim(x)) AS term FROM (SELECT id, unnest(aliases) AS x FROM companies) WHERE trim(x)<>''),
 k AS (SELECT seq, company_id, 0 AS pass, 0 AS p FROM s WHERE coalesce(company_id,'')<>'' UNION ALL SELECT seq, unnest(matched_company_ids), 1, unnest(range(1,len(matched_company_ids)+1)) FROM s
 UNION ALL SELECT DISTINCT b.seq, d.company_id, 2, 0 FROM b JOIN d ON contains(b.t,d.term) AND {_TERM}),
 f AS (SELECT k.seq, k.company_id, min((k.pass, k.p, CASE WHEN k.pass=2 THEN k.company_id ELSE '' END)) AS o FROM k JOIN (SELECT DISTINCT id FROM companies) c ON c.id=k.company_id GROUP BY 1,2),
 r AS (SELECT seq, list(company_id ORDER BY o) AS ids FROM f GROUP BY 1)
"""


def _matched(spark, sf):
    """(seq, ids): the declared company, then those carried along, then those whose alias the text names, by id; only known ones."""
    s = signals(spark, sf)
    pool = read_table(spark, sf, "companies").select(F.col("id").alias("company_id")).distinct()
    alias = read_table(spark, sf, "companies").select(F.col("id").alias("company_id"), F.explode("aliases").alias("x")).select("company_id", F.lower(F.trim("x")).alias("term"))
    alias = alias.filter("term <> ''").distinct()
    none = F.lit("")
    said = s.filter("coalesce(company_id,'') <> ''").select("seq", "company_id", F.struct(F.lit(0).alias("pass"), F.lit(0).alias("p"), none.alias("c")).alias("o"))
    kept = s.select("seq", F.posexplode("matched_company_ids").alias("p", "company_id")).select("seq", "company_id", F.struct(F.lit(1).alias("pass"), "p", none.alias("c")).alias("o"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "summary")
    named = terms.term_hits(s, "seq", text, alias).select("seq", "company_id", F.struct(F.lit(2).alias("pass"), F.lit(0).alias("p"), F.col("company_id").alias("c")).alias("o")).distinct()
    every = said.unionByName(kept).unionByName(named).join(small_side(pool), "company_id", "left_semi")
    # an item names few companies: the arrays are bounded by the pool
    one = every.groupBy("seq", "company_id").agg(F.min("o").alias("o"))
    return one.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "company_id"))), lambda x: x["company_id"]).alias("ids"))


@query(_MATCH + " SELECT seq, ids[1] AS company_id, array_to_string(ids,'|') AS ids FROM r")
def company_resolution(spark, sf):
    return _matched(spark, sf).select("seq", F.get("ids", F.lit(0)).alias("company_id"), F.array_join("ids", "|").alias("ids"))


_FIELDS = ("strategic_topics", "business_actions", "noise_terms")


@query(_MATCH + ", x AS (SELECT seq, i, c.strategic_topics AS a, c.business_actions AS b, c.noise_terms AS n FROM (SELECT seq, unnest(ids) AS id, unnest(range(1,len(ids)+1)) AS i FROM r) JOIN (SELECT DISTINCT ON (id) * FROM companies) c USING (id)) "
       + "SELECT seq, " + ", ".join(f"array_to_string(list_transform(list_filter(list_zip(l{k}, range(1,len(l{k})+1)), lambda z: list_position(l{k},z[1])=z[2]), lambda z: z[1]),'|') AS {f}" for k, f in enumerate(_FIELDS))
       + " FROM (SELECT seq, " + ", ".join(f"flatten(list(coalesce({c},[]) ORDER BY i)) AS l{k}" for k, c in enumerate("abn")) + " FROM x GROUP BY 1)")
def profile_union(spark, sf):
    """The three term lists of an item's companies, joined in order, each term once."""
    c = read_table(spark, sf, "companies").dropDuplicates(["id"]).select("id", *[F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in _FIELDS])
    e = _matched(spark, sf).select("seq", F.posexplode("ids").alias("i", "id")).join(small_side(c), "id")
    g = e.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("i", *_FIELDS))).alias("x"))
    return g.select("seq", *[F.array_join(F.array_distinct(F.flatten(F.col("x")[f])), "|").alias(f) for f in _FIELDS])


@query(S + f""", b AS (SELECT seq, category, signal_type, lower(coalesce(title,'')||' '||summary) AS t FROM s), d AS (SELECT DISTINCT 'topics' AS grp, x AS label, lower(x) AS term FROM (SELECT unnest(strategic_topics) AS x FROM companies) WHERE x<>''
 UNION ALL SELECT DISTINCT 'event_signals', x, lower(x) FROM (SELECT unnest(business_actions) AS x FROM companies) WHERE x<>'')
 SELECT b.seq, d.grp, string_agg(DISTINCT d.label,'|' ORDER BY d.label) AS labels FROM b JOIN d ON contains(b.t,d.term) AND {_TERM} WHERE d.grp<>'event_signals' OR b.category='event' OR b.signal_type='event' GROUP BY 1,2""")
def ontology_groups(spark, sf):
    """Labels by group in the dictionary's order; event signals only of items that are events."""
    c = read_table(spark, sf, "companies")
    dim = lambda g, col: c.select(F.lit(g).alias("grp"), F.explode(col).alias("label")).filter("label <> ''").distinct()
    d = dim("topics", "strategic_topics").unionByName(dim("event_signals", "business_actions")).withColumn("term", F.col("label"))
    s = signals(spark, sf)
    hits = terms.term_hits(s, "seq", F.concat_ws(" ", F.coalesce("title", F.lit("")), "summary"), d)
    gate = hits.join(s.filter("category = 'event' or signal_type = 'event'").select("seq", F.lit(True).alias("_ev")), "seq", "left")
    out = terms.ordered_labels(gate.filter("grp <> 'event_signals' or _ev"), ["seq", "grp"], "label", "label")
    return out.select("seq", "grp", F.array_join("labels", "|").alias("labels"))


@query(_MATCH + """, c AS (SELECT r.seq, bool_or(c.business_role='customer') AS cu, bool_or(c.business_role='competitor') AS co, bool_or(c.business_role='self') AS se FROM (SELECT seq, unnest(ids) AS id FROM r) r JOIN companies c USING (id) GROUP BY 1),
 n AS (SELECT DISTINCT b.seq FROM b JOIN (SELECT DISTINCT lower(p_brand) AS term FROM part) d ON contains(b.t,d.term)) SELECT s.seq, CASE WHEN cu THEN 'customer' WHEN co THEN 'competitor' WHEN se THEN 'self' WHEN n.seq IS NOT NULL THEN 'customer' ELSE 'industry' END AS role
 FROM s LEFT JOIN c ON c.seq=s.seq LEFT JOIN n ON n.seq=s.seq""")
def role_with_names(spark, sf):
    """An item's role by its companies, else customer if it names one of a list, else industry."""
    s = signals(spark, sf)
    roles = read_table(spark, sf, "companies").select(F.col("id"), "business_role").dropDuplicates(["id"])
    c = _matched(spark, sf).select("seq", F.explode("ids").alias("id")).join(small_side(roles), "id")
    c = c.groupBy("seq").agg(*[F.max(F.col("business_role") == r).alias(r) for r in ("customer", "competitor", "self")])
    names = read_table(spark, sf, "part").select(F.lower("p_brand").alias("term")).distinct()
    n = terms.term_hits(s, "seq", F.concat_ws(" ", F.coalesce("title", F.lit("")), "summary"), names).select("seq", F.lit(True).alias("named")).distinct()
    j = s.select("seq").join(c, "seq", "left").join(n, "seq", "left")
    return j.select("seq", F.when(F.col("customer"), "customer").when(F.col("competitor"), "competitor").when(F.col("self"), "self").when(F.col("named"), "customer").otherwise("industry").alias("role"))


@query(S + f""", g AS (SELECT s.*, {range_sql(90)} AS fresh FROM s) SELECT source_id, count(*) AS total, count(*) FILTER (pub IS NULL OR {DAY}-pub<=90) AS fresh, count(*) FILTER (tier IN ('daily','immediate')) AS selected, count(*) FILTER (len(matched_company_ids)>0) AS company_hits,
 CAST(round_even(CAST(count(*) FILTER (tier IN ('daily','immediate')) AS DOUBLE)/count(*)*100,0) AS BIGINT) AS rate FROM g GROUP BY 1""")
def probe_full(spark, sf):
    s = signals(spark, sf)
    sel = F.col("tier").isin(*marts.SELECTED)
    g = s.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("pub").isNull() | (D.age_days(F.col("pub"), today()) <= 90)).alias("fresh"), F.count_if(sel).alias("selected"),
        F.count_if(F.size("matched_company_ids") > 0).alias("company_hits"),
    )
    return g.withColumn("rate", marts.rate(F.col("selected"), F.col("total")))

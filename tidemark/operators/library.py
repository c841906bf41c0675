"""Sources as a library: the catalogue of methods, runtime and errors, health, coverage and boards.

The catalogue is a table (method_id, layer, status, name, note, source_ids): a method may stand for several sources. Every
operator here works on per-source aggregates of the signals, so after one pre-aggregated shuffle the tables are as small as the
configuration; array membership is an explode and an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import marts
from tidemark.session import small_side

METHOD_STATUS = ("active", "available", "planned", "manual", "covered", "blocked", "paid")


def full_health(sources: DataFrame, s: DataFrame, errors: DataFrame, runtime: DataFrame, companies: DataFrame) -> DataFrame:
    """A row per source: counts by tier, status, operational and output status, scope, error and runtime figures.

    errors: (source_id, error), any number a source, of which the last by text stays; runtime: (source_id, raw, new_urls).
    Sources without items, errors or runtime are kept; of repeated source rows one counts.
    """
    src = sources.select(
        F.col("id").alias("source_id"), F.col("label").alias("source_label"), F.coalesce("company_id", F.lit("")).alias("company_id"), "scope_label",
        F.col("type").alias("source_type"), F.coalesce("signal_type", F.lit("news")).alias("signal_type"), F.coalesce("enabled", F.lit(True)).alias("enabled"),
    ).dropDuplicates(["source_id"])
    err = errors.groupBy("source_id").agg(F.max("error").alias("error"))
    run = runtime.groupBy("source_id").agg(F.max("raw").alias("raw"), F.max("new_urls").alias("new_urls"))
    com = companies.select(F.col("id").alias("company_id"), F.col("display_name").alias("_name")).dropDuplicates(["company_id"])
    h = src.join(marts.by_source(s), "source_id", "left").join(small_side(err), "source_id", "left").join(small_side(run), "source_id", "left")
    h = h.join(small_side(com), "company_id", "left").na.fill(0, ["total", "immediate", "daily", "archive", "raw", "new_urls"])
    sel = F.col("immediate") + F.col("daily")
    failed = F.col("error").isNotNull()
    status = F.when(~F.col("enabled"), "pending").when(failed, "error").when(sel > 0, "productive").when(F.col("total") > 0, "archive_only").otherwise("quiet")
    h = h.withColumn("status", status)
    return h.select(
        "source_id", "source_label", "company_id", F.when(F.col("company_id") != "", F.col("_name")).otherwise(F.col("scope_label")).alias("scope"), "source_type",
        "signal_type", "enabled", "status", F.when(~F.col("enabled"), "not_running").when(failed, "error").otherwise("reachable").alias("operational_status"),
        F.when(F.col("status").isin("error", "pending"), "none").otherwise(F.col("status")).alias("output_status"), "total", "immediate", "daily", "archive",
        marts.rate(sel, F.col("total")).alias("selected_rate"), "last_published", F.coalesce("error", F.lit("")).alias("error"), "raw", "new_urls",
    )


def view(health: DataFrame, name: str, stage: str = "all") -> DataFrame:
    """The enabled sources of a view: effective (productive, of one scope) or connected (all, of one status)."""
    h = health.filter("enabled")
    if name == "effective":
        h = h.filter("status = 'productive'")
        return h if stage == "all" else h.filter((F.col("company_id") != "") == (stage == "dedicated"))
    return h if stage == "all" else h.filter(F.col("status") == stage)


def board(health: DataFrame) -> DataFrame:
    """health with its group (dedicated, shared) and its place there: most selected, then most items, then label, then id."""
    group = F.when(F.col("company_id") != "", "dedicated").otherwise("shared")
    order = [F.desc(F.col("immediate") + F.col("daily")), F.desc("total"), F.asc("source_label"), F.asc("source_id")]
    return marts.top_per_key(health.withColumn("board", group), "board", order, 2**31 - 1)


def probed(sources: DataFrame, parts: list[str]) -> DataFrame:
    """Sources whose id holds one of the parts, in any case; no parts: all."""
    if not parts:
        return sources
    low = F.lower("id")
    hit = F.lit(False)
    for p in parts:
        hit = hit | low.contains(p.lower())
    return sources.filter(hit)


def of_sources(catalogue: DataFrame) -> DataFrame:
    """(source_id, method_id, layer, status, ...): the method of each source, the first by method_id."""
    e = catalogue.withColumn("source_id", F.explode(F.array_distinct("source_ids"))).drop("source_ids")
    rest = [c for c in e.columns if c not in ("source_id", "method_id")]
    return e.groupBy("source_id").agg(F.min_by(F.struct("method_id", *rest), "method_id").alias("m")).select("source_id", "m.*")


def live_result(catalogue: DataFrame, health: DataFrame) -> DataFrame:
    """(method_id, state, total, selected, archive, latest): what a method's sources gave; methods of no known source are left out."""
    e = catalogue.select("method_id", F.explode(F.array_distinct("source_ids")).alias("source_id"))
    g = e.join(small_side(health), "source_id").groupBy("method_id").agg(
        F.count_if(F.col("status") == "pending").alias("_p"), F.count_if(F.col("status") == "error").alias("_e"), F.sum("total").alias("total"),
        F.sum(F.col("immediate") + F.col("daily")).alias("selected"), F.sum("archive").alias("archive"), F.max("last_published").alias("latest"),
    )
    state = F.when(F.col("_p") > 0, "pending").when(F.col("_e") > 0, "error").when(F.col("total") > 0, "items").otherwise("none")
    return g.select("method_id", state.alias("state"), "total", "selected", "archive", "latest")


def methods(catalogue: DataFrame, stage: str = "all") -> DataFrame:
    """(layer, visible, total, one column per status): layers with a visible method, of those in the stage; layer null is the sum of all."""
    seen = F.lit(True) if stage == "all" else F.col("status") == stage
    counts = [F.count_if(seen & (F.col("status") == x)).alias(x) for x in METHOD_STATUS]
    return catalogue.rollup("layer").agg(F.count_if(seen).alias("visible"), F.count(F.lit(1)).alias("total"), *counts).filter("visible > 0")


def status_strip(health: DataFrame) -> DataFrame:
    """One row: the number of sources of each status, and of pending or failed ones together."""
    n = lambda x: F.count_if(F.col("status") == x)
    return health.agg(*[n(x).alias(x) for x in marts.STATUS_ORDER], (n("pending") + n("error")).alias("attention"))


def failed(health: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(source_id, message, note): failed sources, with the note of the first method whose name holds the source's id as words."""
    bad = health.filter("status = 'error'").select("source_id", F.when(F.col("error") != "", F.col("error")).otherwise("?").alias("message"))
    words = F.lower(F.replace(F.col("source_id"), F.lit("_"), F.lit(" ")))
    j = bad.join(small_side(catalogue.select("method_id", "name", "note")), F.lower("name").contains(words), "left")
    return j.groupBy("source_id", "message").agg(F.coalesce(F.min_by("note", "method_id"), F.lit("")).alias("note"))


def coverage_rows(slots: DataFrame, health: DataFrame, s: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A row per company, slot and source of slots (company_id, slot, slot_status, source_ids): scope, method's layer, status and counts of that company's items there.

    A source that health doesn't know is pending and shared; failed and pending sources keep their status.
    """
    want = slots.select(F.col("company_id").alias("c"), "slot", F.explode(F.array_distinct("source_ids")).alias("source_id"))
    per = marts.company_source_health(s).select(F.col("company_id").alias("c"), "source_id", "total", "immediate", "daily", "archive")
    h = health.select("source_id", F.col("company_id").alias("_owner"), F.col("status").alias("_status"))
    j = want.join(small_side(h), "source_id", "left").join(per, ["c", "source_id"], "left").na.fill(0, ["total", "immediate", "daily", "archive"])
    j = j.join(small_side(of_sources(catalogue).select("source_id", "layer")), "source_id", "left")
    sel = F.col("immediate") + F.col("daily")
    known = F.coalesce("_status", F.lit("pending"))
    status = F.when(known.isin("error", "pending"), known).when(sel > 0, "productive").when(F.col("total") > 0, "archive_only").otherwise("quiet")
    scope = F.when(F.col("_owner") == F.col("c"), "dedicated").otherwise("shared")
    return j.select(F.col("c").alias("company_id"), "slot", "source_id", scope.alias("scope"), F.coalesce("layer", F.lit("unsorted")).alias("layer"), status.alias("status"), "total", sel.alias("selected"), "archive")


def coverage_page(slots: DataFrame, rows: DataFrame, definitions: int) -> DataFrame:
    """(company_id, dedicated, shared, covered, gaps): distinct sources by scope, and slots covered of those defined."""
    by = rows.groupBy("company_id").agg(
        F.countDistinct(F.when(F.col("scope") == "dedicated", F.col("source_id"))).alias("dedicated"), F.countDistinct(F.when(F.col("scope") == "shared", F.col("source_id"))).alias("shared")
    )
    n = slots.groupBy("company_id").agg(F.countDistinct(F.when(F.col("slot_status").isin("active", "covered"), F.col("slot"))).alias("covered"))
    gaps = F.greatest(F.lit(0), F.lit(definitions) - F.col("covered"))
    return n.join(by, "company_id", "left").na.fill(0, ["dedicated", "shared"]).select("company_id", "dedicated", "shared", "covered", gaps.cast("long").alias("gaps"))


def dock(companies: DataFrame, roles: list[str], name: Column, rank: Column) -> DataFrame:
    """(role, n, members): the companies of each role by rank (none last), then name; a role without any is kept. The pool is configuration."""
    dom = companies.sparkSession.createDataFrame([(r,) for r in roles], "role string")
    c = companies.dropDuplicates(["id"]).select(F.col("business_role").alias("role"), F.struct(F.coalesce(F.when(rank > 0, rank), F.lit(2**31 - 1)).alias("r"), name.alias("n"), "id").alias("x"))
    g = c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("x")).alias("x"))
    j = dom.join(g, "role", "left").na.fill(0, ["n"])
    return j.select("role", "n", F.coalesce(F.array_join(F.transform("x", lambda v: v["n"]), " | "), F.lit("")).alias("members"))


def summary_budget(s: DataFrame, eligible: Column, limit: int) -> DataFrame:
    """The first limit eligible items, immediate ones first, then by score: a top-k, nothing is sorted in whole."""
    return s.filter(eligible).orderBy(F.when(F.col("tier") == "immediate", 0).otherwise(1), F.desc("score"), "seq").limit(limit)


def summary_status(requested: bool, resolved: bool, failed_: bool, eligible: int, limit: int) -> str:
    """How a run's optional summaries went."""
    if not requested:
        return "rules_only"
    if not resolved:
        return "configuration_error"
    if failed_:
        return "request_error"
    return "limit_reached" if eligible > limit else "complete"


def exit_code(errors: int, strict: bool) -> int:
    """Of a daily run: 2 for errors if they are not to be passed over."""
    return 2 if strict and errors else 0


def probe_exit_code(errors: int, sources: int) -> int:
    """Of a probe: 1 if every source failed."""
    return 1 if errors == sources else 0

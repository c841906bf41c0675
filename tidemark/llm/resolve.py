"""Variant spellings of organisation names linked by merge-and-rematch resolution.

Names are parsed once per distinct spelling. A form is a parsed name: kind, stem, field of work or given name. Forms that
say enough to stand alone are strict; bare stems, ambiguous fields ("bio", "inst") and initials are open. Open forms are
blocked once with all forms by their stems' slip keys. Round by round they meet the profiles - merged forms with the union of
their stems, fields, given names and initials - by these pairs; matched forms join their profile, whose new stems are met in
the next round, until no form is merged any more. An open form that fits more than one profile is left alone, exact stems before slips.

Scale: work is per distinct form, not per record; blocking is an equi-join on slip keys (a dozen a stem) that also hold the
kind and field where both are known. Steps are few, as each adds plans, threads and generated code to the driver's memory, and
tables of exploded keys are never broadcast, as the planner can't tell their size. Hot organisations are many records of few forms and cost a join at the end, on the
form's id, whose small side has a row per form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import names as N
from tidemark.operators.components import components
from tidemark.session import drop_stored, stored

#: Bytes of edges between forms up to which one task finds their components (about two million).
WHOLE = 32 << 20

PARSED = "spelling string, kind string, stem string, fields array<string>, given array<string>, initial string, key string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [N.parse(s) for s in b["spelling"]]
        yield pd.DataFrame(
            {
                "spelling": b["spelling"], "kind": [x.kind for x in got], "stem": [x.stem for x in got], "fields": [sorted(x.fields) for x in got],
                "given": [sorted(x.given) for x in got], "initial": [x.initial for x in got], "key": [x.key for x in got],
            }
        )


def _slips(s: pd.Series) -> pd.Series:
    return s.map(lambda x: N.slips(x) if x else [])


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([N.same_stem(x, y) for x, y in zip(a, b)], dtype=bool)


def parsed(spellings: DataFrame) -> DataFrame:
    """forms: each distinct spelling with its parse, the id of its form and whether that is strict."""
    p = spellings.select("spelling").distinct().mapInPandas(_parse, PARSED)
    named = ~F.col("kind").isin("alias", "nobody")
    strict = (
        F.when(F.col("kind") == "person", F.size("given") == 1)
        .when(F.col("kind") == "company", F.size("fields") == 1)
        .when(F.col("kind").isin("institute", "center"), F.size("fields") == 1)
        .otherwise(named)
    )
    text = F.concat_ws("|", "kind", "stem", F.concat_ws("+", "fields"), F.concat_ws("+", "given"), "initial")
    fid = F.when(named, F.xxhash64(text)).when(F.col("kind") == "alias", F.xxhash64(F.concat(F.lit("alias|"), F.col("key"))))
    return p.withColumn("strict", strict & named).withColumn("fid", fid)


def _keyed(forms: DataFrame) -> DataFrame:
    slips = F.pandas_udf(_slips, T.ArrayType(T.StringType()))
    return forms.withColumn("slip", F.explode(slips(F.col("stem"))))


def _pairs(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Rows of left (stem) joined with rows of right (ps) whose stem is the same but for a slip, once for each a and b.

    A pair shares several slip keys; one of equal stems is kept at the stem itself. Sizes after the explosion are unknown to
    the planner, so neither side may be broadcast.
    """
    same = F.pandas_udf(_same, T.BooleanType())
    hit = _keyed(left).join(_keyed(right.withColumn("stem", F.col("ps"))).drop("stem").hint("merge"), ["slip", *on])
    hit = hit.filter((F.col(a) != F.col(b)) & ((F.col("stem") != F.col("ps")) | (F.col("stem") == F.col("slip")))).drop("slip")
    return hit.repartition(a).dropDuplicates([a, b]).filter(same(F.col("stem"), F.col("ps")))


def resolve(companies: DataFrame, relations: DataFrame, rounds: int = 1000) -> DataFrame:
    """(rec, is_company, entity): the organisation each record names; records that name nobody or can't be told are left out.

    companies: id, display_name, aliases; relations: id, organization. Null, blank and placeholder names name nobody; null
    aliases and repeated rows are fine; a name may be of any length; empty tables give no rows.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    c = companies.select("id", F.split("display_name", r"\s+/\s+").alias("d"), F.coalesce("aliases", F.array().cast("array<string>")).alias("a"))
    c = c.select("id", F.explode(F.array_distinct(F.concat(F.coalesce("d", F.array().cast("array<string>")), "a"))).alias("spelling"), F.lit(True).alias("is_company"))
    named = c.unionByName(relations.select("id", F.col("organization").alias("spelling"), F.lit(False).alias("is_company")))
    named = named.filter("spelling is not null and id is not null")
    p = kept(parsed(named.select("spelling")), "parsed")
    uses = named.join(p.filter("fid is not null").select("spelling", "fid", "kind", "strict"), "spelling")
    uses = kept(uses.select("id", "is_company", "fid", "kind", "strict").distinct(), "uses")
    forms = p.filter("fid is not null and kind <> 'alias'").groupBy("fid").agg(
        *[F.min(x).alias(x) for x in ("kind", "stem", "fields", "given", "initial", "strict")]
    )
    forms = kept(forms.join(uses.groupBy("fid").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "fid"), "forms")

    # strict forms: one slip apart, alike in all else; and the strict forms of one company
    strict = forms.filter("strict").withColumn("rest", F.concat_ws("|", "kind", F.concat_ws("+", "fields"), F.concat_ws("+", "given")))
    # umlauts written out or not are one spelling; a slip is rarer than what it slipped from. A form with a much more frequent
    # neighbour joins the most frequent one only, so that two slips never bridge two names; the rest join one another.
    bare = F.replace(F.replace(F.replace("stem", F.lit("oe"), F.lit("o")), F.lit("ae"), F.lit("a")), F.lit("ue"), F.lit("u"))
    one = Window.partitionBy("rest", "bare")
    spelled = strict.withColumn("bare", bare).withColumn("n", F.sum("n").over(one)).withColumn("hub", F.min("fid").over(one))
    spelled = kept(spelled.select("fid", "stem", "rest", "n", "hub"), "spelled")
    near = _pairs(
        spelled.select("rest", F.col("fid").alias("a"), "stem", F.col("n").alias("na")),
        spelled.select("rest", F.col("fid").alias("b"), F.col("stem").alias("ps"), F.col("n").alias("nb")), ["rest"], "a", "b",
    )
    centre = F.max(F.when(F.expr("nb >= greatest(4, 3 * na)"), F.struct("nb", -F.col("b"), F.col("b").alias("c")))).over(Window.partitionBy("a"))
    near = kept(near.select("a", "b", "na", "nb", centre.alias("x")).select("a", "b", "na", "nb", "x.c"), "near")
    # each pair is there both ways: neither of its forms may have a centre
    peers = near.filter("least(na, nb) < 8").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bool_and(F.col("c").isNull()).alias("free"))
    own = uses.filter("is_company and strict").select("id", "fid")
    hub = own.select(F.min("fid").over(Window.partitionBy("id")).alias("a"), F.col("fid").alias("b")).filter("a <> b")
    edges = near.filter("c is not null").select("a", F.col("c").alias("b")).unionByName(peers.filter("free").select("a", "b"))
    edges = edges.unionByName(spelled.filter("hub <> fid").select(F.col("hub").alias("a"), F.col("fid").alias("b"))).unionByName(hub)
    root = components(edges, whole=WHOLE)
    # what a profile says comes from its strict forms only, so it stands from here on; open forms add their stems
    says = Window.partitionBy("root")
    assigned = forms.filter("strict").join(root.withColumnRenamed("id", "fid"), "fid", "left").withColumn("root", F.coalesce("root", "fid"))
    assigned = kept(
        assigned.select(
            "fid", "root", F.array_distinct(F.flatten(F.collect_set("fields").over(says))).alias("pf"),
            F.array_distinct(F.flatten(F.collect_set("given").over(says))).alias("pg"),
        ),
        "profiles",
    )

    # open forms and all forms with the same stem but for a slip, both persons or neither
    about = F.concat_ws("|", "kind", F.concat_ws("+", "fields"), F.concat_ws("+", "given"), "initial")
    reach = _pairs(
        forms.filter("not strict").select("fid", "stem", "kind", "fields", "given", "initial", (F.col("kind") == "person").alias("person"), about.alias("about")),
        forms.select(F.col("fid").alias("m"), F.col("stem").alias("ps"), F.col("kind").alias("pk"), (F.col("kind") == "person").alias("person"), "strict", about.alias("pabout")),
        ["person"], "fid", "m",
    )
    reach = kept(
        reach.select(
            "fid", "m", "strict", F.when(F.col("stem") == F.col("ps"), 0).otherwise(1).alias("far"), (F.col("kind") == F.col("pk")).alias("kin"),
            (F.col("about") == F.col("pabout")).alias("alike"), "person", "fields", "given", "initial",
        ),
        "reach",
    )

    def met(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
        """(fid, root, far, ok, pf, pg, done): the profiles whose stems open forms have, and whether these fit."""
        fits = F.when(
            F.col("person"),
            (F.size("given") > 0) & F.arrays_overlap("given", "pg") | (F.col("initial") != "") & F.exists("pg", lambda g: F.substring(g, 1, 1) == F.col("initial")),
        ).otherwise((F.size("fields") == 0) | F.col("kin") & F.arrays_overlap("fields", "pf"))
        got = pairs.join(profiles.select(F.col("fid").alias("m"), "root", "pf", "pg"), "m")
        return got.select("fid", "root", "far", F.coalesce(fits, F.lit(False)).alias("ok"), "pf", "pg", F.lit(False).alias("done"))

    first = kept(met(reach.filter("strict"), assigned), "first")
    among = reach.filter("not strict")
    joined: DataFrame | None = None
    cand = first
    for _ in range(rounds):
        if joined is not None:
            cand = first.unionByName(met(among, joined)).unionByName(joined.withColumns({"far": F.lit(0), "ok": F.lit(False), "done": F.lit(True)}))
        fit, exact = F.when(F.col("ok"), F.col("root")), F.when(F.col("ok") & (F.col("far") == 0), F.col("root"))
        best = cand.groupBy("fid").agg(
            F.min(F.when(F.col("ok"), F.struct("far", "root", "pf", "pg"))).alias("x"), F.max("done").alias("done"),
            (F.min(fit) == F.max(fit)).alias("single"), (F.min(exact) == F.max(exact)).alias("single_exact"),
        ).filter("not done and (single or single_exact)").select("fid", "x.root", "x.pf", "x.pg")
        best = kept(best, "joined")
        if best.isEmpty():
            break
        joined = best if joined is None else joined.unionByName(best)
    else:
        raise RuntimeError(f"resolve: profiles still grow after {rounds} rounds")

    # open forms that fit no profile at all: one slip apart and alike in all else
    free = forms.filter("not strict").select("fid").join(cand.select("fid").distinct(), "fid", "left_anti")
    free = kept(free, "free")
    loose = among.filter("alike and fid < m").select(F.col("fid").alias("a"), F.col("m").alias("b"))
    loose = loose.join(free.select(F.col("fid").alias("a")), "a", "left_semi").join(free.select(F.col("fid").alias("b")), "b", "left_semi")
    lroot = components(loose, whole=WHOLE)
    free = free.join(lroot.withColumnRenamed("id", "fid"), "fid", "left").withColumn("root", F.coalesce("root", "fid"))
    entity = assigned.select("fid", "root").unionByName(free)
    if joined is not None:
        entity = entity.unionByName(joined.select("fid", "root"))
    entity = kept(entity, "entities")

    companies_of = kept(own.join(entity, "fid").select("id", "root").distinct(), "companies_of")
    # nicknames, codes and names in other scripts: by the company that lists them, if that is one organisation
    alias = uses.filter("is_company and (kind = 'alias' or not strict)").select("id", "fid").join(companies_of, "id")
    alias = alias.groupBy("fid").agg(F.min("root").alias("listed"), F.max("root").alias("_m")).filter("listed = _m").select("fid", "listed")
    rel = uses.filter("not is_company").select("id", "fid", "kind").join(entity, "fid", "left").join(alias, "fid", "left")
    rel = rel.withColumn("root", F.coalesce("listed", "root", F.when(F.col("kind") == "alias", F.col("fid")))).filter("root is not null")
    rel = rel.select(F.col("id").alias("rec"), F.lit(False).alias("is_company"), F.col("root").alias("entity"))
    com = companies_of.select(F.col("id").alias("rec"), F.lit(True).alias("is_company"), F.col("root").alias("entity"))
    out = stored(com.unionByName(rel).distinct(), "members")
    for df in [*made, root, lroot]:
        drop_stored(df)
    return out


def found_pairs(membership: DataFrame) -> DataFrame:
    """(id_a, id_b): company and relationship, two companies, or two relationships of an organisation that no company is."""
    com = membership.filter("is_company").select(F.col("rec").alias("x"), "entity")
    rel = membership.filter("not is_company").select(F.col("rec").alias("y"), "entity")
    cr = com.join(rel, "entity").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    cc = com.join(com.select(F.col("x").alias("y"), "entity"), "entity").filter("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    outside = rel.join(com.select("entity").distinct(), "entity", "left_anti")
    rr = outside.join(outside.select(F.col("y").alias("z"), "entity"), "entity").filter("y < z").select(F.col("y").alias("id_a"), F.col("z").alias("id_b"))
    return cr.unionByName(cc).unionByName(rr)

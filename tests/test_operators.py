import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import components, dedupe, graph, marts, rules, state, terms
from tidemark.sources import sinks


def test_components_of_random_graphs_with_a_hub(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(150)] + [(500, 501 + k) for k in range(200)] + [(i, i + 1) for i in range(800, 860)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.range(999).selectExpr("id as a", "id + 1 as b")
    got = {r.id: r.root for r in components.components(path).collect()}
    assert got == dict.fromkeys(range(1000), 0)
    with pytest.raises(RuntimeError):
        components.components(path, rounds=1)


def serial(rows):
    urls, titles, out = {}, {}, {}
    for seq, u, t in sorted(rows):
        lead = urls.get(u) if u else None
        if lead is None and t:
            lead = titles.get(t)
        if lead is None:
            lead = seq
            if u:
                urls[u] = seq
            if t:
                titles[t] = seq
        out[seq] = lead
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=25))
def test_greedy_equals_serial_fold(spark, picks):
    pad = "abcdefghijklmnopqrstuvwxyzabcdefgh"
    rows = [(i, f"http://x.org/{u}" if u else None, pad + str(t) if t else "short") for i, (u, t) in enumerate(picks)]
    df = spark.createDataFrame(rows, "seq long, url string, title string")
    got = {r.seq: r.leader for r in dedupe.leaders(df).collect()}
    assert got == serial([(s, u, t if len(t) >= 30 else None) for s, u, t in rows])


def test_greedy_is_not_transitive_and_merges(spark):
    t = "a headline that is long enough to count "
    rows = [(1, "", "http://a", t + "one", "short", ["s1"], ""), (2, "c2", "http://b", t + "one", "a longer text", ["s2", "s1"], "2026-01-01"), (3, "c3", "http://b", t + "three", "x", ["s3"], "")]
    df = spark.createDataFrame(rows, "seq long, company_id string, url string, title string, summary string, source_ids array<string>, published string")
    lead = dedupe.leaders(df)
    assert {r.seq: r.leader for r in lead.collect()} == {1: 1, 2: 1, 3: 3}
    m = {r.leader: r for r in dedupe.merged(df, lead).collect()}
    assert (m[1].source_ids, m[1].company_ids, m[1].summary, m[1].published, m[1].n_rows) == (["s1", "s2"], ["c2"], "a longer text", "2026-01-01", 2)


def test_term_hits_match_plain_and_other_scripts(spark):
    rows = spark.createDataFrame([(1, "New ADC for CAR-T and 抗体医薬"), (2, "adcetris"), (3, None)], "k long, t string")
    dim = spark.createDataFrame([("adc", "ADC", 1), ("cart", "CAR-T", 2), ("ab", "抗体", 3), ("none", None, 4)], "label string, term string, o int")
    hits = terms.term_hits(rows, "k", F.col("t"), dim)
    assert {(r.k, r.label) for r in hits.collect()} == {(1, "adc"), (1, "cart"), (1, "ab")}
    assert terms.ordered_labels(hits, ["k"], "o", "label").first().labels == ["adc", "cart", "ab"]


def test_rules(spark):
    df = spark.createDataFrame([(1, "x"), (50, None)], "n int, s string")
    score, why = rules.additive([(F.col("n") > 10, 40, "big"), (F.col("s") == "x", 5, "x")], most=42)
    got = df.select(score.alias("p"), why.alias("w"), rules.decide([(F.col("n") > 10, "many")], "few").alias("d")).collect()
    assert [(r.p, r.w, r.d) for r in got] == [(5, ["x"], "few"), (40, ["big"], "many")]


@pytest.mark.parametrize("part,whole,even,up", [(1, 8, 12, 13), (23, 40, 57, 57), (0, 0, 0, 0)])
def test_rate(spark, part, whole, even, up):
    df = spark.createDataFrame([(part, whole)], "a long, b long")
    r = df.select(marts.rate(F.col("a"), F.col("b")).alias("e"), marts.rate(F.col("a"), F.col("b"), False).alias("u")).first()
    assert (r.e, r.u) == (even, up)


def test_state(spark):
    seen = spark.createDataFrame([("a", 1)], "key string, first int")
    new = spark.createDataFrame([("a", 2), ("b", 2), ("b", 2)], "key string, first int")
    once = state.upsert_seen(seen, new)
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, state.upsert_seen(once, new).collect())) == [("a", 1), ("b", 2)]
    cur = spark.createDataFrame([("s", "k1"), ("s", "k2"), ("t", "k3")], "source_id string, key string")
    old = spark.createDataFrame([("s", "k1")], "source_id string, key string")
    assert [tuple(r) for r in state.snapshot_diff(cur, old).collect()] == [("s", "k2")]
    ok = spark.createDataFrame([("t",)], "source_id string")
    assert sorted(map(tuple, state.replace_snapshot(old, cur.filter("source_id='t'"), ok).collect())) == [("s", "k1"), ("t", "k3")]
    fb = spark.createDataFrame([("i", "up", 1), ("i", None, 2), ("j", "down", 1)], "id string, v string, at int")
    assert [tuple(r) for r in state.last_feedback(fb, "id", "v", "at").collect()] == [("j", "down")]


def test_graph(spark):
    rel = spark.createDataFrame([("h", "Org A", "investor", ["t1", None]), ("h", "org a ", "investor", None), ("h", None, "x", None)], "hub_company_id string, organization string, relationship_type string, topics array<string>")
    comp = spark.createDataFrame([("c1", "competitor"), ("c2", "customer")], "id string, business_role string")
    nodes, edges = graph.graph(rel, comp)
    assert {tuple(r) for r in edges.collect()} == {("hub:h", "org:org a", "investor"), ("org:org a", "topic:t1", "topic"), ("hub:h", "company:c1", "competitor")}
    assert {r.node: r.degree for r in graph.degrees(edges).collect()}["hub:h"] == 2
    n, e = graph.induced(nodes, edges, F.col("kind") != "topic")
    assert (n.count(), e.count()) == (3, 2)
    assert graph.neighbours(e, "hub:h").count() == 2


def test_sinks(spark, tmp_path):
    rows = [(1, "daily", 5, "T", "u", 'say "x"', ["a", "b"], "product", "news"), (2, "archive", 9, "U", None, "s" * 300, [], "event", "news"), (3, "archive", 1, "V", "u", "", None, "event", "video")]
    df = spark.createDataFrame(rows, "seq long, tier string, score int, title string, url string, summary string, arr array<string>, category string, signal_type string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("seq").collect()
    assert (back[0].summary, back[0].arr) == ('say "x"', "a; b")
    sinks.static_api(df, str(tmp_path / "api"))
    assert spark.read.json(str(tmp_path / "api/daily")).count() == 1
    text = {r.section: r.text for r in sinks.report_markdown(df).collect()}
    assert text["archive"].splitlines()[2].startswith("1. [U]") and "..." in text["archive"]
    for k, day in enumerate(("2026-01-01", "2026-01-02", "2026-01-02")):
        sinks.write_history(spark.createDataFrame([(k, day)], "n int, date string"), str(tmp_path / "h"))
    assert {(r.n, str(r.date)) for r in spark.read.parquet(str(tmp_path / "h")).collect()} == {(0, "2026-01-01"), (2, "2026-01-02")}
    assert [r.n for r in sinks.read_history(spark, str(tmp_path / "h"), 1).collect()] == [2]
    over = sinks.overlay(df.select("seq", "title"), spark.createDataFrame([(1, "live")], "seq long, title string"), "seq", ["title"])
    assert {r.seq: r.title for r in over.collect()} == {1: "live", 2: "U", 3: "V"}

import random
from collections import Counter

import pytest

from tidemark.llm import incremental as I

ORDINARY = {"recalls", "lots", "over", "labelling", "error", "today", "clears", "approves", "moves", "joins", "to", "as", "head", "reagent", "the", "for", "from", "line"}


@pytest.mark.parametrize("a,b,same", [
    ("Acme Labs recalls Zentol lots AB12 over labelling error", "ACME LABS RECALLS ZENTOL LOTS AB12 OVER LABELLING ERROR", True),
    ("Acme Labs recalls Zentol lots AB12 over labelling error", "Acme Labs today recalls Zentol lots AB12 over labeling error", True),
    ("Acme Labs recalls Zentol lots AB12 over labelling error", "Acme Labs recalls Zentol lots ...", True),
    ("Acme Labs recalls Zentol lots AB12 over labelling error", "Acme Labs recalls Zentol lots AB13 over labelling error", False),
    ("Acme Labs recalls Zentol lots AB12 over labelling error", "Acme Labs recalls Zentil lots AB12 over labelling error", False),
    ("Regulator clears Zentol from Acme Labs", "Regulator approves Zentol from Acme Labs", True), ("Deal tracker No. 194", "Deal tracker No. 195", False),
    ("Jane Roe joins Acme as head for the Zentol line", "Zentol line Jane Roe joins Acme as head for the", True), ("", "", False), ("What we know", "What we know", True),
    ("ノズワリスルの治験で中間結果を公表", "ネムクマホズの治験で中間結果を公表", False),
])
def test_same_headline(a, b, same):
    assert I.same_headline(a, b, lambda w: w in ORDINARY) is same
    assert I.same_headline(b, a, lambda w: w in ORDINARY) is same


SCHEMA = "candidate_id long, title string, url string"


def found(spark, history, batch):
    h, b = spark.createDataFrame(history, SCHEMA), spark.createDataFrame(batch, SCHEMA)
    clash = ["*", "1 as id", "2 as key", "3 as fp", "4 as page"]
    return {(r.first_id, r.candidate_id) for r in I.batch_repeats(h.selectExpr(*clash), b.selectExpr(*clash)).collect()}


def test_chains_pages_nulls_and_repeats(spark):
    title = "Vemax Bioprocess opens Lyon site to make Zentoltex and Quarivan"
    filler = [(100 + k, f"Regulator clears Prod{k}x from Firm{k}y after data", f"http://f.example/p/{k}") for k in range(60)]
    history = [(1, title, "http://a.example/p/1"), (2, title + " - Big Herald", "http://b.example/p/2"), (3, None, None), (4, "", ""), *filler, (1, title, "http://a.example/p/1")]
    batch = [
        (1001, "What we know", "http://www.b.example/p/2?utm_source=x"), (1002, "News: " + title.upper(), "http://c.example/p/9"), (1003, None, None), (1004, "", ""),
        (1005, "Something else entirely about Morvex", "http://d.example/p/1"), (1006, "Something else entirely about Morvex", "http://e.example/p/1"),
        (1007, "Regulator clears Prod7x from Firm9y after data", "http://g.example/p/1"), (1008, "x " * 50_000, "http://h.example/p/1"),
        (1006, "Something else entirely about Morvex", "http://e.example/p/1"), (None, title, "http://a.example/p/1"),
    ]
    assert found(spark, history, batch) == {(1, 1001), (1, 1002), (1005, 1006)}


def test_empty(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [(1, "a title", "http://a.example/p/1")], []) == set()
    assert found(spark, [], [(1, "Acme joins Vemax on Zentol", "http://a.example/p/1"), (2, "other", "https://a.example/p/1/")]) == {(1, 2)}


def test_batch_by_batch_equals_all_at_once(spark, tmp_path):
    h = spark.createDataFrame([(k, f"Regulator clears Prod{k}x from Firm{k}y after data", f"http://f.example/p/{k}") for k in range(50)], SCHEMA)
    rows = [(1000 + k, f"Exclusive: Regulator clears Prod{k % 70}x from Firm{k % 70}y after data", f"http://n.example/p/{k}") for k in range(0, 120, 3)]
    batches = [spark.createDataFrame(rows[:20], SCHEMA), spark.createDataFrame(rows[20:], SCHEMA)]
    index = I.Index.build(h, "candidate_id", "title", "url", path=f"file://{tmp_path}/index", buckets=3)
    got = {tuple(r) for r in I.repeats(index, index.append(batches[0], "candidate_id", "title", "url")).collect()}
    index.close()
    # another session takes the index up where it was left
    index = I.Index.open(spark, f"file://{tmp_path}/index")
    got |= {tuple(r) for r in I.repeats(index, index.append(batches[1], "candidate_id", "title", "url")).collect()}
    once = {tuple(r) for r in I.batch_repeats(h, batches[0].unionByName(batches[1])).collect()}
    assert got == once and len(got) > 20
    assert len(index.parts) == 3 and index.buckets == 3
    index.close()


def test_look_ups_leave_the_index_where_it_is(spark, monkeypatch):
    monkeypatch.setattr(I, "FEW_KEYS", 0)
    monkeypatch.setattr(I, "small_side", lambda df: df)
    rows = [(k, f"Regulator clears Prod{k}x from Firm{k}y after data", None) for k in range(200)]
    index = I.Index.build(spark.createDataFrame(rows, SCHEMA), "candidate_id", "title", "url", buckets=3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.hits(index.parts[0]["heads"].limit(5).select("h", "w"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning(key") <= 1 and "Bucketed: true" in plan


def test_radius_decides_what_is_compared(spark):
    pairs = clipped_and_slipped(200, 1, 5, 0.3, 0.45)
    index = I.Index.build(spark.createDataFrame([(k, t, None) for k, (t, _) in enumerate(pairs)], SCHEMA), "candidate_id", "title", "url")
    rows = index.append(spark.createDataFrame([(10_000 + k, c, None) for k, (_, c) in enumerate(pairs)], SCHEMA), "candidate_id", "title", "url")
    mine = index.parts[1]["heads"].select("h", "w")
    n = index.hits(mine).groupBy("equal").count().collect()
    beyond = sum(r["count"] for r in n if I.BLOCKS - r["equal"] > I.RADIUS)
    assert 0 < beyond and beyond > 0.3 * sum(r["count"] for r in n) and rows.count() == 200


TEMPLATES = (
    "Regulator clears {} from {} {} after {} {} files new {} data", "Why {} matters for {} as {} results from {} {} surprise experts in {}",
    "{} {} raises funds to bring {} into studies with {} {} and {}", "{} trial by {} {} misses its goal as the {} arm of {} {} goes on",
)


def clipped_and_slipped(n, slips, seed, least, most):
    """(title, copy): the copy ends between these parts of the title, with slips in as many of the words left."""
    rnd = random.Random(seed)
    parts = [a + b + c for a in ("Ba", "Co", "Du", "Fe", "Gi") for b in ("lira", "mozo", "nexu", "pavi", "qued", "rilo") for c in ("tan", "vex", "mab", "sol")]
    names = [rnd.choice(parts) + rnd.choice(parts).lower() for _ in range(300)]
    pairs = []
    for _ in range(n):
        title = rnd.choice(TEMPLATES).format(*[rnd.choice(names) for _ in range(6)])
        words = title.split()
        words = words[: round(len(words) * rnd.uniform(least, most))]
        long = [i for i, w in enumerate(words) if len(w) > 4]
        for k in rnd.sample(long, min(slips, len(long))):
            at = rnd.randrange(1, len(words[k]) - 1)
            words[k] = words[k][:at] + words[k][at + 1 :]
        pairs.append((title, " ".join(words) + " ..."))
    return pairs


def recall(spark, pairs):
    """The part of the pairs that same_headline() accepts for which a look-up of the copy finds the tie."""
    lower = Counter(w for t, _ in pairs for w in I._SPLIT.findall(t) if w[0].islower())
    want = {(k, 10_000 + k) for k, (t, c) in enumerate(pairs) if I.same_headline(t, c, lambda w: lower[w] >= 3)}
    index = I.Index.build(spark.createDataFrame([(k, t, None) for k, (t, _) in enumerate(pairs)], SCHEMA), "candidate_id", "title", "url")
    copies = spark.createDataFrame([(10_000 + k, c, None) for k, (_, c) in enumerate(pairs)], SCHEMA)
    rows = index.append(copies, "candidate_id", "title", "url")
    ids = {r.h: set() for p in index.parts for r in p["heads"].collect()}
    for r in I.prepared(spark.createDataFrame([(k, t, None) for k, (t, _) in enumerate(pairs)], SCHEMA).unionByName(copies), "candidate_id", "title", "url").collect():
        ids[r.h].add(r.id)
    got = {(a, b) for r in index.ties(rows.select("h").distinct()).collect() for x in ids[r.a] for y in ids[r.b] for a, b in [(min(x, y), max(x, y))]}
    got |= {(a, b) for s in ids.values() for a in s for b in s if a < b}
    assert len(want) > 20
    return len(want & got) / len(want)


def test_recall_of_clips_with_slips(spark):
    assert recall(spark, clipped_and_slipped(600, 1, 5, 0.3, 0.45)) > 0.9


def test_all_rows_of_a_page_look_up(spark):
    headline, page = "Vemax Bioprocess opens Lyon site to make Zentoltex", "http://a.example/p/1"
    history = [(1, headline, "http://b.example/p/1"), (2, "What we know", page), (3, headline, page)]
    assert found(spark, history, [(1001, "Something else about Morvex", page)]) == {(1, 1001)}


def test_two_slips_in_five_words(spark):
    a, b = "Acme Labs recalls Zentoltex lots", "Acme Labs recals Zentoltex lotss"
    assert I.same_headline(a, b, lambda w: False)
    assert found(spark, [(1, a, "http://a.example/p/1")], [(1001, b, "http://b.example/p/1")]) == {(1, 1001)}


def test_bound_is_an_error(spark):
    index = I.Index.build(spark.createDataFrame([(1, "a title", "http://a.example/p/1")], SCHEMA), "candidate_id", "title", "url")
    batch = spark.createDataFrame([(2, "other", "http://a.example/p/1")], SCHEMA)
    rows = index.append(batch, "candidate_id", "title", "url")
    with pytest.raises(RuntimeError):
        I.repeats(index, rows, rounds=1)

import random
import re

from tidemark.llm import leaks as L
from tidemark.llm import text as X


def brute(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", X.comparable(t or ""))
    idx = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            idx.setdefault(tuple(w[k : k + 12]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - 11) for i in idx.get(tuple(w[k : k + 12]), ())}


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as w")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as id")
    return L.leaks(d, "doc_id", "text", i, "item_id", "text")


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(rnd.randrange(5, 60)))) for i in range(30)]
    docs = []
    for d in range(150):
        w = [word() for _ in range(rnd.randrange(80))]
        for _ in range(rnd.randrange(3)):
            src = rnd.choice(items)[1].split()
            a, n = rnd.randrange(len(src)), rnd.randrange(8, 20)
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in src[a : a + n]]
        docs.append((d, " ".join(w)))
    got = {(r.doc_id, r.item_id) for r in run(spark, docs, items).collect()}
    assert got == brute(docs, items) and len(got) > 20


def test_edges(spark):
    text = " ".join(f"word{k}" for k in range(14))
    docs = [(1, None), (2, ""), (3, "short"), (4, "x\n“" + text.replace(" ", ", ") + "”"), (5, "pad " * 100_000 + text), (4, text), (6, " ".join(text.split()[:11])), (7, text.replace("word3", "wоrd3")), (None, text)]
    items = [(1, text), (1, text), (2, None), (3, ""), (4, "too short"), (5, text), (None, text)]
    got = {(r.doc_id, r.item_id): (r.run, r.item_words) for r in run(spark, docs, items).collect()}
    assert got == {(d, i): (14, 14) for d in (4, 5, 7) for i in (1, 5)}
    assert run(spark, docs, []).count() == 0 and run(spark, [], items).count() == 0


def test_sketch_only_spares_work(spark, monkeypatch):
    texts = [" ".join(f"i{i}w{k}" for k in range(15)) for i in range(5)]
    docs = list(enumerate(texts)) + [(9, " ".join(f"i{k % 5}w{k % 15}" for k in range(200)))]
    want = {(i, i) for i in range(5)}
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, list(enumerate(texts))).collect()} == want
    full = L.S.table
    monkeypatch.setattr(L.S, "table", lambda p: full(p) * 0 + 1)
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, list(enumerate(texts))).collect()} == want


def test_one_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    docs = [(k, f"a{k} b{k} " + (passage if k % 3 == 0 else "other words " * 6)) for k in range(300)]
    got = run(spark, docs, [(1, "x y " + passage), (2, "p1 p2 p3 p4 p5 p6 p7 p8 p9 q p10 p11 p12")])
    assert {(r.doc_id, r.item_id, r.run) for r in got.collect()} == {(k, 1, 13) for k in range(0, 300, 3)}

import collections
import random

import numpy as np
import pytest

from tidemark.llm import nearsim as N
from tidemark.llm import sketch as S

SCHEMA = "k long, title string, summary string, url string"


def brute(rows, t=0.75):
    words = {}
    for k, a, b, _ in rows:
        if b and b.strip():
            words[k] = collections.Counter(((a or "") + " " + b).lower().split())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def tie(a, b):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    ks = sorted(words)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            common = sum((words[a] & words[b]).values())
            if common and common >= t * sum((words[a] | words[b]).values()):
                tie(a, b)
    urls = collections.defaultdict(list)
    for k, _, _, u in rows:
        if u:
            urls[u].append(k)
    for v in urls.values():
        for x in v[1:]:
            tie(v[0], x)
    g = collections.defaultdict(set)
    for x in parent:
        g[find(x)].add(x)
    return {(a, b) for v in g.values() for a in v for b in v if a < b}


def corpus(seed, n=220, vocabulary=60):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and rnd.random() < 0.5:
            w = rows[rnd.randrange(len(rows))][2].split()
            for _ in range(rnd.randrange(7)):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(vocabulary)}"
            rnd.shuffle(w)
        else:
            w = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randrange(3, 40))]
        rows.append((k, "w1", " ".join(w), f"http://x.example/p/{rnd.randrange(2000)}"))
    return rows


@pytest.mark.parametrize("widest", [8192, 20])
def test_groups_equal_brute_force(spark, widest):
    rows = corpus(widest)
    df = spark.createDataFrame(rows, SCHEMA)
    ties = N.text_ties(df, "k", "title", "summary", widest=widest)
    from tidemark.operators.components import components

    pages = N.star(N.scanned(df, "k", "url", "title", "summary").filter("page is not null").select("id", "page"), ["page"])
    got = {(r.id_a, r.id_b) for r in N.group_pairs(components(ties.unionByName(pages))).collect()}
    assert got == brute(rows)


def test_edges_of_the_data(spark):
    text = "one two three four five six seven eight"
    rows = [(1, None, text, None), (2, "", text, ""), (3, "x", None, "http://a.example/p/1"), (4, "x", "", "http://www.a.example/p/1?utm_source=q"), (5, "x", "   ", None), (6, "y", "unlike", None)]
    rows += [(7, "", "lang " * 60_000, None), (8, "", "lang " * 59_000, None), (1, None, text, None), (None, None, text, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as page", "3 as w")
    got = {(r.id_a, r.id_b) for r in N.group_pairs(N.groups(df, "k", "title", "summary", "url")).collect()}
    assert got == {(1, 2), (3, 4), (7, 8)}
    assert N.groups(spark.createDataFrame([], SCHEMA), "k", "title", "summary", "url").count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(k, "t", "the same text again and again", f"http://x.example/p/{k}") for k in range(300)] + [(1000 + k, "t", f"some a{k} b{k} c{k} text", None) for k in range(500)]
    m = N.groups(spark.createDataFrame(rows, SCHEMA), "k", "title", "summary", "url")
    assert m.count() == 300 and m.select("root").distinct().count() == 1


def test_sliced_counting_equals_direct():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, (40, 2), dtype=np.int64).view(np.uint64)
    b = base[rnd.integers(0, 40, 500)] ^ (np.uint64(1) << rnd.integers(0, 64, (500, 2), dtype=np.uint64))
    for radius in (0, 2, 4, 20, 63, 127, 128):
        lo, hi = np.arange(40) * 3, 300 + np.arange(40) * 5
        lo[7] = hi[7] = 9
        got = [(i, j) for x in N.sliced_pairs(base, b, lo, hi, lambda i, last: np.full(len(i), radius)) for i, j in zip(*x)]
        d = np.bitwise_count(base[:, None, :] ^ b[None, :, :]).sum(axis=2)
        wi, wj = np.nonzero((d <= radius) & (np.arange(500) >= lo[:, None]) & (np.arange(500) < hi[:, None]))
        assert sorted(got) == sorted(zip(wi, wj))


@pytest.mark.parametrize("buffer", [50, 400_000])
def test_blocks_longer_than_a_buffer(monkeypatch, buffer):
    import pyarrow as pa

    monkeypatch.setattr(N, "BUFFER", buffer)
    rnd = np.random.default_rng(4)
    rows = 600
    key = np.sort(rnd.choice([1, 2, 2, 2, 2, 2, 2, 3, 4, 5], rows))
    n = rnd.integers(4, 40, rows).astype(np.int32)
    order = np.lexsort((n, key))
    key, n, part = key[order], n[order], rnd.integers(1, 4, rows).astype(np.int8)
    ids = rnd.permutation(rows)
    s = rnd.integers(0, 2**63, (3, 2), dtype=np.int64)[rnd.integers(0, 3, rows)] ^ (1 << rnd.integers(0, 60, (rows, 2)))
    names = ["key", "salt", "id", "n", "s1", "s2", "part"]
    cols = [key, np.zeros(rows, np.int32), ids, n, s[:, 0], s[:, 1], part]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 40]) for c in cols], names=names) for k in range(0, rows, 40)]
    got = {tuple(p) for b in N._pairs(0.75)(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    want = set()
    for i in range(rows):
        for j in range(rows):
            d = sum(int(x ^ y).bit_count() for x, y in zip(s[i].tolist(), s[j].tolist()))
            if i != j and key[i] == key[j] and part[i] & 1 and part[j] & 2 and n[i] <= n[j] and 4 * n[i] >= 3 * n[j] and 7 * d <= int(n[i]) + int(n[j]):
                want.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    assert got == want and len(want) > 100


def test_parity_never_exceeds_difference():
    rnd = random.Random(2)
    for _ in range(50):
        a = [rnd.randrange(1 << 60) for _ in range(40)]
        b = a[: rnd.randrange(40)] + [rnd.randrange(1 << 60) for _ in range(rnd.randrange(20))]
        h, r = N.tokens(np.array(a + b, np.int64).view(np.uint64), np.array([len(a), len(b)]))
        p = N.parity(h, r, 2)
        sa, sb = set(h[r == 0].tolist()), set(h[r == 1].tolist())
        assert int(np.bitwise_count(p[0] ^ p[1]).sum()) <= len(sa ^ sb)


def test_packed_order_equals_full_sort():
    rnd = np.random.default_rng(3)
    row = np.sort(rnd.integers(0, 50, 2000))
    h = rnd.integers(0, 2**63, 2000).astype(np.uint64)
    h[::3] = (h[::3] >> np.uint64(60)) | np.uint64(1 << 62)  # many that differ in their last bits only
    q = rnd.integers(0, 4, 2000).astype(np.uint8)
    assert (h[S.grouped_order(row, h)] == h[np.lexsort((h, row))]).all()
    o = S.grouped_order(row, h, q)
    assert (h[o] == h[np.lexsort((h, q, row))]).all()

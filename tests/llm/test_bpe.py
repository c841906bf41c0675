import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe


@pytest.fixture(scope="module")
def coders():
    data = open(bpe.VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.Encoder(data), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_equals_public_library(coders, text):
    text = text.encode("utf-8", "ignore").decode()
    assert coders[0].encode(text) == coders[1].encode_ordinary(text)


def test_long_pre_tokens(coders):
    rnd = random.Random(1)
    for text in ("a" * 20_000, "ab" * 9_000, "".join(rnd.choice("abcde") for _ in range(15_000)), "あいう" * 5_000, "<|endoftext|>"):
        assert coders[0].encode(text) == coders[1].encode_ordinary(text)


def test_queue_gives_least_rank_leftmost():
    q, rnd, ref = bpe.RankQueue(50_000), random.Random(2), []
    for _ in range(3000):
        if rnd.random() < 0.6:
            x = (rnd.randrange(50_000), rnd.randrange(100))
            q.push(*x)
            ref.append(x)
        elif ref:
            assert q.pop() == min(ref)
            ref.remove(min(ref))
    while ref:
        assert q.pop() == min(ref)
        ref.remove(min(ref))
    assert q.pop() is None


def test_rows(spark, coders):
    df = spark.createDataFrame([(1, "Hello  world"), (2, ""), (3, None), (4, " \n "), (1, "Hello  world"), (None, "x")], "doc_id long, text string").selectExpr("*", "'x' as key", "array(1) as ids")
    got = [(r.doc_id, r.ids) for r in bpe.encoded(df, "doc_id", "text").collect()]
    assert got.count((1, coders[1].encode_ordinary("Hello  world"))) == 2
    assert (2, []) in got and (3, []) in got and (4, coders[1].encode_ordinary(" \n ")) in got
    assert bpe.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_long_batches_go_out_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "PIECE_IDS", 5)
    with open(bpe.VOCABULARY, "rb") as f:
        data = f.read()
    shared = type("V", (), {"value": data})()
    texts = ["one two three four five six seven", None, "", "eight", "nine ten", "eleven " * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["key", "text"])
    got = list(bpe._encode(shared)(iter([batch])))
    e = bpe.Encoder(data)
    assert len(got) > 1
    assert [(k, i) for b in got for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())] == [(k, e.encode(t or "")) for k, t in enumerate(texts)]
